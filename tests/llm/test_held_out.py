"""Classifiers on rows that they haven't learned from, and the pipeline as a whole."""

import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import DATA
from tracklane.llm import quality_classifier, toxicity
from tracklane.llm.language_model import op3_language_model
from tracklane.llm.quality_classifier import op5_quality_classifier
from tracklane.llm.toxicity import op2_toxicity

SF = f"{DATA}/sf0.01"


@pytest.mark.parametrize(("query", "label", "least"), [(op5_quality_classifier, "quality", (0.5, 0.95)), (op2_toxicity, "toxic", (0.95, 0.6))])
def test_held_out_recall_of_each_label(spark, query, label, least):
    """``least``: of the held-out documents with label 0 and with label 1, the share that is predicted so."""
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    for y in (0, 1):
        right = [p == y for p, t in held if t == y]
        assert len(right) >= 8 and np.mean(right) >= least[y], (label, y, len(right), np.mean(right))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert len({r["score"] for r in rows}) > 100
    if label == "toxic":
        texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        assert all(len(r["evidence"]) == 3 for r in rows if any(c.isascii() and c.isalnum() for c in texts[r["doc_id"]]))


def test_held_out_documents_are_likelier_than_by_their_words_alone(spark):
    rows = [r for r in op3_language_model(spark, SF).collect() if r["held_out"]]
    assert len(rows) > 100 and sum(r["score"] for r in rows) > 0.97 * sum(r["base_score"] for r in rows)


def test_scores_cover_odd_texts(docs, spark):
    net = quality_classifier.fit([b"good words here", b"bad!! bad!!"] * 10, np.array([1, 0] * 10, np.float32), epochs=2)
    got = quality_classifier.score(docs, net).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    sample = [(i, "vile thing" if i % 2 else "fine thing", i % 2) for i in range(40)]
    got = toxicity.toxicity(docs, sample).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)


def test_fitting_sees_all_chunks():
    luck = np.random.default_rng(1)
    net = quality_classifier.Network(luck.normal(0, 1, (quality_classifier.WIDTH, 256, quality_classifier.FILTERS)).astype(np.float32), luck.normal(0, 1, quality_classifier.FILTERS).astype(np.float32), luck.normal(0, 1, 2 * quality_classifier.FILTERS + 1).astype(np.float32))
    texts = [b"", b"abc", *(bytes(luck.integers(97, 123, n).astype(np.uint8)) for n in (511, 512, 513, 960, 961, 400_000))]
    tops, windows, counts = quality_classifier._winners(net, texts)
    act, at = np.maximum(tops, 0), np.concatenate([[0], np.cumsum(counts)[:-1]])
    feats = np.concatenate([np.maximum.reduceat(act, at), np.add.reduceat(act, at) / np.array(counts)[:, None]], 1)
    assert quality_classifier.pooled(net, texts[:1]) == pytest.approx(quality_classifier.pooled(net, texts)[:1])  # whatever follows an empty text
    assert feats == pytest.approx(quality_classifier.pooled(net, texts), rel=1e-4, abs=1e-5) and len(windows) == sum(counts)
    data = texts[1] + bytes(quality_classifier.WIDTH)
    plain = [[sum(net.table[j, data[i + j], f] for j in range(quality_classifier.WIDTH)) for i in range(3)] for f in range(quality_classifier.FILTERS)]
    top = np.maximum(np.max(plain, 1) + net.bias, 0)
    assert quality_classifier.predict(net, [texts[1]])[0] == pytest.approx(1 / (1 + np.exp(-(np.concatenate([top, top]) @ net.head[:-1] + net.head[-1]))), rel=1e-4)


def test_pooling_covers_the_whole_text():
    net = quality_classifier.Network(np.random.default_rng(0).normal(0, 1, (quality_classifier.WIDTH, 256, quality_classifier.FILTERS)).astype(np.float32), np.zeros(quality_classifier.FILTERS, np.float32), np.zeros(2 * quality_classifier.FILTERS + 1, np.float32))
    text = bytes(np.random.default_rng(1).integers(97, 123, 600_000).astype(np.uint8))
    alone = quality_classifier.pooled(net, [text])[0, : quality_classifier.FILTERS]
    full = quality_classifier.responses(net.table, np.frombuffer(text + bytes(quality_classifier.WIDTH - 1), np.uint8))
    assert alone == pytest.approx(np.maximum(full.max(0), 0), rel=1e-5)


def test_pipeline_stages(spark, docs, rows):
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, None)
        assert out.columns == corpus_pipeline.COLUMNS, name
        out = out.persist()
    assert out.count() > 0
    final = corpus_pipeline.run(spark, f"{DATA}/sf0.001")
    assert final.columns[0] == "doc_id" and final.count() > 0
