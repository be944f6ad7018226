"""What the operators of this subpackage share: words, tables in the shared folder, prefix sums."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a longest run of anything but the six ASCII blanks. ``bytes.split()`` splits likewise.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def utf8(text: str | Column) -> Column:
    """The text as bytes; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(utf8(F.col(doc_id).cast("string"))) % modulus


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none: one of our own on one machine, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracklane-")
        spark.conf.set("spark.checkpoint.dir", root)
        _drop_at_exit(spark, root)
    return root.rstrip("/")


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def stored(df: DataFrame, name: str, batch_bytes: int = 16 << 20) -> DataFrame:
    """Write the rows to a table in the shared folder and read them back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation. The table goes when the session ends, and the
    shuffle files that it was made from, which nothing reads again, as soon as it is written.
    ``batch_bytes`` bounds what reaches a Python worker at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(batch_bytes)}
    with _settings:
        before = {k: spark.conf.get(k) for k in wanted}
        for k, v in wanted.items():
            spark.conf.set(k, v)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
    _drop_at_exit(spark, path)
    for paths in _blocks():
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Held while a table is written under settings of its own: one thread at a time.
_settings = threading.RLock()
_own = threading.local()


def _blocks() -> list[list[str]]:
    """Paths of the tables stored since each of the blocks that this thread has open began."""
    if not hasattr(_own, "blocks"):
        _own.blocks = []
    return _own.blocks


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored within the block go at its end. What is needed later is stored after it, or taken out by ``kept``."""
    _blocks().append([])
    try:
        yield
    finally:
        for path in _blocks().pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """A stored table that outlives the blocks that are open."""
    held = [len(paths) for paths in _blocks()]
    out = stored(df, name)
    for paths, n in zip(_blocks(), held, strict=True):
        del paths[n:]
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)
