"""Every registered query of this part, as the driver runs it: names, types, rows, and its SQL where it has one."""

import zlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from tests.conftest import DATA
from tracklane.llm import entries

SF = f"{DATA}/sf0.001"
COLUMNS = {
    "op1_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_language_model": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op4_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op5_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op8_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op9_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
}


def test_all_are_registered():
    assert {*COLUMNS, "pipeline"} <= set(__spark_entry__.queries()) and set(entries.QUERIES) == set(COLUMNS)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, duck, name):
    df = entries.QUERIES[name](spark, SF)
    assert [f"{c} {t}" for c, t in df.dtypes][: len(COLUMNS[name].split(", "))] == COLUMNS[name].split(", ")
    rows, texts = df.collect(), dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    if name != "op7_packing":
        assert Counter(r["doc_id"] for r in rows) == Counter(texts.keys())
    if name in entries.ORACLE_SQL:
        out = duck.execute(entries.ORACLE_SQL[name])
        names = [d[0] for d in out.description]
        assert set(names) == set(df.columns)
        assert Counter(tuple(r[c] for c in names) for r in rows) == Counter(out.fetchall())
    if name == "op4_sharding":
        shards, sizes = {}, Counter()
        for r in rows:
            text = texts[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "bytes", None)
            shards.setdefault(text, set()).add(r["shard"])
            sizes[r["shard"]] += r["size"]
        assert all(len(x) == 1 for x in shards.values()) and set(sizes) == set(range(8))
    if name == "op7_packing":
        tokens = Counter()
        for r in rows:
            tokens[r["doc_id"]] += r["length"]
        assert tokens == {r["doc_id"]: r["doc_tokens"] for r in rows} and set(tokens) == set(texts)
    if name in ("op2_toxicity", "op5_quality_classifier"):
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
