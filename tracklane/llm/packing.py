"""Packing by concatenate and cut.

All documents, each as its token ids and one end id, form one long stream that is cut into windows of equal length.
Pass one encodes a partition, gives every document its offset within the partition and stores the ids. The sums of
the partitions, one number each, are then added up, which turns local offsets into global ones. Pass two cuts every
document at the multiples of the window length: a document that crosses a boundary leaves one piece on either side.
Only the last window can be short.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.llm.common import documents, stored

LENGTH = 1024
#: Code points encoded at once; a longer text is cut before a lone space between two words, where ids don't depend on it.
CHUNK = 1 << 16


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the ranks of the public byte-level tokenizer lie on this machine; they are those of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """The ids that the tokenizers library gives for byte_bpe_50k.json without special tokens added.

    The same vocabulary and splitting pattern are run by tiktoken, which takes a fifth of the time; tests compare both.
    """

    def __init__(self, path: str | None = None, special: dict[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or vocabulary(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = {"<|endoftext|>": 50256} if special is None else special
        self.inner = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.allowed = set(self.special)
        self.largest = max([*ranks.values(), *self.special.values()], default=0)

    def _parts(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > CHUNK:
            at = start + CHUNK
            while at < len(text) - 1 and not (text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()):
                at += 1
            if at >= len(text) - 1:
                break
            yield text[start:at]
            start = at
        yield text[start:]

    def ids(self, text: str) -> np.ndarray:
        parts = [self.inner.encode_to_numpy(x, allowed_special=self.allowed) for x in self._parts(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, ranks: str | None = None) -> DataFrame:
    """Pass one, stored: each document's ids with the end id, and its offset within its partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = Encoder(ranks), TaskContext.get().partitionId(), 0
        width = "<u2" if max(encoder.largest, end_id) < 1 << 16 else "<u4"  # the second pass tells it by the bytes of an id
        for batch in batches:
            offsets, sizes, ids = [], [], []
            for text in batch.column(1).to_pylist():
                own = np.append(encoder.ids(text or ""), end_id).astype(width)
                offsets.append(at)
                sizes.append(len(own))
                ids.append(own.tobytes())
                at += len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["id", "part", "local", "doc_tokens", "ids"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(encode, schema), "pack")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = 0, ranks: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32 bits each), doc_tokens, sequence_id, offset.

    Sequences are ``length`` ids long but for the last. A null text is an empty one: its piece holds the end id alone.
    Ids may be null or repeat; every row of ``docs`` is a document. No rows give no pieces. Other columns aren't read.
    ``ranks`` is the path of the vocabulary's file on every executor; by default that of the installed public one.
    """
    rows = encoded(docs, id_col, text_col, end_id, ranks)
    sums = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()}  # a number per partition
    parts = sorted(sums)
    bases = dict(zip(parts, [0, *accumulate(sums[p] for p in parts)][:-1], strict=True)) if parts else {}
    shared = docs.sparkSession.sparkContext.broadcast(bases)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        for batch in batches:
            part, local, tokens, raw = (batch.column(i).to_pylist() for i in (1, 2, 3, 4))
            row, start, size, ids, total, where, held = [], [], [], [], [], [], 0

            def out():
                g = np.array(where, np.int64)
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(g // length), pa.array(g % length)],
                    ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

            for i in range(batch.num_rows):
                own = np.frombuffer(raw[i], f"<u{len(raw[i]) // tokens[i]}").astype("<u4")
                g, a = base[part[i]] + local[i], 0
                while a < len(own):
                    b = min(len(own), a + length - (g + a) % length)
                    row.append(i)
                    start.append(a)
                    size.append(b - a)
                    ids.append(own[a:b].tobytes())
                    total.append(len(own))
                    where.append(g + a)
                    a = b
                held += 4 * len(own)
                if held > 16 << 20:
                    yield out()
                    row, start, size, ids, total, where, held = [], [], [], [], [], [], 0
            if row:
                yield out()

    fields = [T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in ("start", "length")], T.StructField("ids", T.BinaryType()), *[T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset")]]
    return rows.mapInArrow(cut, T.StructType(fields)).withColumnRenamed("id", id_col)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
