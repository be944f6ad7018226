"""The driver's contract: every query with SQL gives the rows of its SQL."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tests.conftest import DATA
from tracklane.plans import queries

SF = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    assert got[1]
    if name in queries.ORACLE_SQL:
        r = duck.execute(queries.ORACLE_SQL[name])
        assert got == rows_of([d[0] for d in r.description], r.fetchall())


def test_results_dont_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = sorted(map(str, queries.numbered_segments(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(map(str, queries.numbered_segments(spark, SF).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_clusters_are_dense(spark):
    labels = {}
    for r in queries.kmeans_exact_k(spark, SF).collect():
        labels.setdefault(r["file_id"], set()).add(r["label"])
    assert labels and all(x == set(range(len(x))) and len(x) <= 4 for x in labels.values())


def test_entry_works_without_the_training_data_part(tmp_path):
    top = Path(__file__).resolve().parents[1]
    for p in top.rglob("*.py"):
        if "llm" not in p.parts and p.name != "corpus_pipeline.py":
            to = tmp_path / p.relative_to(top)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(queries.QUERIES)), str(len(queries.ORACLE_SQL))], out.stderr
