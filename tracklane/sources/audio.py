"""Audio files as signals, decoded in the Python workers that read them: WAV, and what has an opener (``containers``)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.errors import AudioEmpty, AudioError
from tracklane.operators.signal import mixed_down, resampled
from tracklane.schemas import SAMPLE_RATE, SIGNALS
from tracklane.sources.containers import Opener, openers, read

# Codes of sample formats in a WAV header.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def decoded(content: bytes, path: str = "", more: dict[str, Opener] | None = None) -> tuple[int, np.ndarray]:
    """Sample rate and mono samples in -1..1. A file that ends before its data does is an error, not a short signal.

    What isn't WAV by its content is opened by its extension, by one of ``more`` (those that are registered).
    """
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        opener = (openers() if more is None else more).get(path.rpartition(".")[2].lower())
        if opener is None:
            raise AudioError(f"{path}: not a WAV file, and nothing is registered that opens it")
        return read(opener(content, path), path)
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            form = (struct.unpack_from("<H", body, 24)[0] if code == EXTENSIBLE and len(body) >= 26 else code, channels, rate, bits)
        elif name == b"data":
            if form is None:
                raise AudioError(f"{path}: the data come before their format")
            if len(body) < size:
                raise AudioError(f"{path}: truncated, {size - len(body)} bytes are missing")
            samples = mixed_down(_values(body, form[0], form[3], path), form[1])
            if not len(samples):
                raise AudioEmpty(path)
            return form[2], samples
        at += 8 + size + size % 2
    raise AudioEmpty(path)


def _values(body: bytes, code: int, bits: int, path: str) -> np.ndarray:
    if code == FLOAT and bits in (32, 64):
        return np.frombuffer(body, f"<f{bits // 8}").astype(np.float32)
    if code == PCM and bits == 8:
        return (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
    if code == PCM and bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    if code == PCM and bits in (16, 32):
        return np.frombuffer(body, f"<i{bits // 8}").astype(np.float32) / (1 << (bits - 1))
    raise AudioError(f"{path}: samples of {bits} bits with code {code} can't be read")


def signals(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, sample_rate, samples): each file that ``path`` names, mono at 16 kHz; file_id is its path."""

    more = openers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rate, samples = decoded(content, name, more)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([SAMPLE_RATE], pa.int32()), pa.array([resampled(samples, rate)], pa.list_(pa.float32()))], ["file_id", "sample_rate", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SIGNALS)


def gaps_filled(frames: DataFrame) -> DataFrame:
    """(file_id, frame, p, total): frames missing up to the file's last are silence, so that later ones keep their place."""
    every = frames.groupBy("file_id").agg(F.max("frame").alias("last"), F.max("total").alias("total")).select("file_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame"))
    return every.join(frames.select("file_id", "frame", "p"), ["file_id", "frame"], "left").select("file_id", "frame", F.coalesce("p", F.lit(0.0)).alias("p"), "total")
