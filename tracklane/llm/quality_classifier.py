"""Quality classifier: a byte-level convolutional network in numpy.

Filters over windows of bytes are learned from one-hot bytes, so a filter is a table with a row for each offset and
byte, and a convolution is a sum of table rows. A document is cut into overlapping chunks that cover all of it; the
largest response of each filter within a chunk is kept, and the mean and the largest of these over all chunks are
combined by a logistic layer into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.llm.common import documents, fold, labels
from tracklane.llm.labelled import labelled_sample

FILTERS, WIDTH = 16, 6
#: Bytes of a chunk, and of the part that it shares with the next.
CHUNK, OVERLAP = 512, 64
#: Labelled documents that the network is fitted on, at most, and passes over them.
TRAIN_ROWS, EPOCHS = 2048, 4
#: Bytes whose responses are held at once, and chunks while fitting.
BLOCK, STEP = 1 << 18, 512


@dataclass
class Network:
    table: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    head: np.ndarray  # 2 * FILTERS + 1


def chunk_starts(n: int) -> np.ndarray:
    """Where chunks of a text of n bytes start; the last one reaches its end."""
    step = CHUNK - OVERLAP
    return np.arange(0, max(1, n - OVERLAP), step)


def responses(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Each filter at each window of the bytes."""
    n = len(data) - WIDTH + 1
    out = table[0][data[:n]]
    for j in range(1, WIDTH):
        out += table[j][data[j : j + n]]
    return out


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Per text: the largest and the mean, over its chunks, of each filter's largest response."""
    out = np.zeros((len(texts), 2 * FILTERS), np.float32)
    group: list[int] = []
    size = 0
    for i in range(len(texts) + 1):
        if group and (i == len(texts) or size + len(texts[i]) > BLOCK):
            _pool(net, [texts[k] for k in group], group, out)
            group, size = [], 0
        if i < len(texts):
            group.append(i)
            size += len(texts[i])
    return out


def _pool(net: Network, texts: list[bytes], rows: list[int], out: np.ndarray) -> None:
    if len(texts) == 1 and len(texts[0]) > BLOCK:  # in stretches of whole steps; the overlap is read twice
        step = (BLOCK // (CHUNK - OVERLAP)) * (CHUNK - OVERLAP)
        most, total, count = None, 0, 0
        for a in range(0, max(1, len(texts[0]) - OVERLAP), step):
            top = _chunk_maxima(net, [texts[0][a : a + step + OVERLAP]])[0]
            most = top.max(0) if most is None else np.maximum(most, top.max(0))
            total, count = total + top.sum(0), count + len(top)
        out[rows[0]] = np.concatenate([most, total / count])
        return
    top, counts = _chunk_maxima(net, texts)
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out[rows, :FILTERS] = np.maximum.reduceat(top, at)
    out[rows, FILTERS:] = np.add.reduceat(top, at) / np.array(counts, np.float32)[:, None]


def _chunk_maxima(net: Network, texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    data = np.frombuffer(b"".join(x + bytes(WIDTH) for x in texts) + bytes(1), np.uint8)
    full = responses(net.table, data)
    bounds, counts, at = [], [], 0
    for x in texts:
        s = chunk_starts(len(x))
        bounds.append(np.stack([at + s, at + np.maximum(np.minimum(s + CHUNK, len(x)), s + 1)], 1))
        counts.append(len(s))
        at += len(x) + WIDTH
    flat = np.concatenate(bounds).ravel()
    return np.maximum(np.maximum.reduceat(full, flat)[::2] + net.bias, 0), counts


def predict(net: Network, texts: list[bytes]) -> np.ndarray:
    z = pooled(net, texts) @ net.head[:-1] + net.head[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _winners(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Of every chunk of the texts and each filter: the largest response, and the bytes of the window that has it.

    Chunks are the same as in scoring, all of them, STEP at a time; also how many each text has.
    """
    rows, ends, counts, tops, windows = [], [], [], [], []

    def out() -> None:
        x = np.stack(rows)
        full = net.table[0][x[:, :CHUNK]]
        for j in range(1, WIDTH):
            full += net.table[j][x[:, j : j + CHUNK]]
        full[np.arange(CHUNK) >= np.array(ends)[:, None]] = -np.inf
        where = full.argmax(1)
        tops.append(np.take_along_axis(full, where[:, None], 1)[:, 0] + net.bias)
        windows.append(x[np.arange(len(x))[:, None, None], where[:, :, None] + np.arange(WIDTH)])
        rows.clear()
        ends.clear()

    for text in texts:
        data, starts = np.frombuffer(text + bytes(CHUNK + WIDTH), np.uint8), chunk_starts(len(text))
        counts.append(len(starts))
        for a in starts:
            rows.append(data[a : a + CHUNK + WIDTH - 1])
            ends.append(max(1, len(text) - a))
            if len(rows) == STEP:
                out()
    if rows:
        out()
    return np.concatenate(tops), np.concatenate(windows), counts


def fit(texts: list[bytes], truth: np.ndarray, seed: int = 0, epochs: int = EPOCHS, batch: int = 16, rate: float = 0.01) -> Network:
    """Back-propagation through both poolings, over all chunks: only the window that won a chunk passes the gradient on."""
    luck = np.random.default_rng(seed)
    share = float(np.clip(truth.mean() if len(truth) else 0.5, 0.01, 0.99))
    net = Network(luck.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), luck.normal(0, 0.1, 2 * FILTERS + 1).astype(np.float32))
    net.head[-1] = np.log(share / (1 - share))
    if not len(texts) or len(set(truth.tolist())) < 2:
        net.head[:-1] = 0
        return net
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.table, net.bias, net.head)]
    steps = 0
    for epoch in range(epochs):
        order = luck.permutation(len(texts))
        for b in range(0, len(order), batch):
            ids = order[b : b + batch]
            top, windows, counts = _winners(net, [texts[i] for i in ids])
            act = np.maximum(top, 0)
            at = np.concatenate([[0], np.cumsum(counts)[:-1]])
            most, n = np.maximum.reduceat(act, at), np.array(counts, np.float32)[:, None]
            feats = np.concatenate([most, np.add.reduceat(act, at) / n], 1)
            p = 1 / (1 + np.exp(-np.clip(feats @ net.head[:-1] + net.head[-1], -30, 30)))
            err = ((p - truth[ids]) / len(ids)).astype(np.float32)
            g_feats = err[:, None] * net.head[:-1]
            doc = np.repeat(np.arange(len(ids)), counts)
            g_act = g_feats[doc, FILTERS:] / n[doc] + g_feats[doc, :FILTERS] * (act == most[doc])
            g_top = g_act * (top > 0)
            g_table = np.zeros_like(net.table)
            for j in range(WIDTH):
                np.add.at(g_table[j], (windows[:, :, j], np.arange(FILTERS)), g_top)
            grads = [g_table + 1e-5 * net.table, g_top.sum(0), np.concatenate([feats.T @ err, [err.sum()]]) + 1e-4 * net.head]
            steps += 1
            pace = rate * (0.5 if epoch == epochs - 1 else 1) * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
            for p_, g, (m, v) in zip((net.table, net.bias, net.head), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and the network's probability of label 1, from the bytes of the whole text.

    A null text counts as empty, whose one chunk holds padding only. Ids may be null or repeat. Other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((net.table, net.bias, net.head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(*shared.value)
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(predict(own, texts).astype(np.float64))], ["id", "score"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sample = labelled_sample(docs, labels(spark, sf_dir), "quality", fold("doc_id", 5) != 0, TRAIN_ROWS)
    net = fit([t.encode() for _, t, _ in sample], np.array([y for _, _, y in sample], np.float32))
    scored = score(docs, net)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
