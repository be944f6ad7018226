"""Transforms of samples: mixing down channels, resampling, quantizing, framing, peaks, mel features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.schemas import SAMPLE_RATE

# Fixed values of the resampling filter: half its length in zero crossings, and its cutoff.
HALF_LENGTH, CUTOFF = 128, 0.95


def arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Each list's numbers as float32, without Python objects between; a null list is empty."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for i, there in enumerate(column.is_valid().to_pylist()):
        yield np.asarray(values[ends[i] : ends[i + 1]] if there else values[:0], np.float32)


def mixed_down(interleaved: np.ndarray, channels: int) -> np.ndarray:
    """Mean of the channels; an incomplete last frame goes."""
    channels = max(1, channels)
    n = len(interleaved) // channels
    return interleaved[: n * channels].reshape(n, channels).mean(1, dtype=np.float32)


def _window(x: np.ndarray) -> np.ndarray:
    """Squared Blackman-Harris over -1..1."""
    t = np.pi * (x + 1)
    w = 0.35875 - 0.48829 * np.cos(t) + 0.14128 * np.cos(2 * t) - 0.01168 * np.cos(3 * t)
    return w * w


def resampled(samples: np.ndarray, rate: int, to: int = SAMPLE_RATE, block: int = 1 << 14) -> np.ndarray:
    """Windowed-sinc interpolation; the signal itself where rates agree or it is empty."""
    if rate == to or not len(samples):
        return samples.astype(np.float32)
    ratio = to / rate
    cut = CUTOFF * min(1.0, ratio)
    half = int(np.ceil(HALF_LENGTH / min(1.0, ratio)))
    count = int(round(len(samples) * ratio))
    padded_ = np.concatenate([np.zeros(half, np.float32), samples.astype(np.float32), np.zeros(half + 1, np.float32)])
    taps = np.arange(-half + 1, half + 1)
    out = np.empty(count, np.float32)
    for a in range(0, count, block):
        at = np.arange(a, min(count, a + block)) / ratio
        base = np.floor(at).astype(np.int64)
        d = taps[None] - (at - base)[:, None]
        kernel = cut * np.sinc(cut * d) * _window(np.clip(d / half, -1, 1))
        out[a : a + len(at)] = (padded_[base[:, None] + taps[None] + half] * kernel).sum(1)
    return out


def quantized(sample: Column) -> Column:
    """A sample as 16 bits: held to -1..1, scaled, cut towards zero."""
    held = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sample.cast("double")))
    return (held * 32767).cast("smallint")


def framed(signals: DataFrame, size: int) -> DataFrame:
    """(file_id, frame, samples): frames of equal size, the last one filled with silence; an empty signal has none."""
    n = F.size("samples")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = signals.select("file_id", "samples", F.explode(starts).alias("frame"))
    part = F.slice("samples", F.col("frame") * size + 1, size)
    full = F.concat(part, F.array_repeat(F.lit(0.0).cast("float"), F.lit(size) - F.size(part)))
    return rows.select("file_id", F.col("frame").cast("long").alias("frame"), full.alias("samples"))


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))


def magnitude_scores(frames: DataFrame) -> DataFrame:
    """(file_id, frame, p): 0.9 for a frame whose peak exceeds 0.1, else 0. Needs no model."""
    return frames.select("file_id", "frame", F.when(peak(F.col("samples")) > 0.1, 0.9).otherwise(0.0).alias("p"))


def mel_filters(bins: int, n_fft: int = 400, rate: int = SAMPLE_RATE) -> np.ndarray:
    """Triangles of equal area, evenly spaced on the mel scale that is linear up to 1 kHz."""
    to_mel = lambda f: np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) * 27 / np.log(6.4))
    to_hz = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))
    edges = to_hz(np.linspace(0, to_mel(np.array(rate / 2.0)), bins + 2))
    freqs = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (freqs[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - freqs[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(samples: np.ndarray, bins: int = 80, n_fft: int = 400, hop: int = 160, most: int = 3000) -> np.ndarray:
    """bins x most features. A column belongs to a hop of input; columns before the first full transform stay 0."""
    out = np.zeros((bins, most), np.float32)
    hops = min(most, -(-len(samples) // hop))
    filters, window = mel_filters(bins, n_fft), np.hanning(n_fft + 1)[:-1]
    data = np.concatenate([samples, np.zeros(hop)])
    for column in range(hops):
        end = (column + 1) * hop
        if end >= n_fft:
            power = np.abs(np.fft.rfft(data[end - n_fft : end] * window)) ** 2
            logs = np.log10(np.maximum(filters @ power, 1e-10))
            out[:, column] = (np.maximum(logs, logs.max() - 8) + 4) / 4
    return out


def mel_features(signals: DataFrame, bins: int = 80, most: int = 3000) -> DataFrame:
    """(file_id, bins, columns, features): one row per signal, features row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [log_mel(s, bins, most=most) for s in arrays(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([bins] * len(made), pa.int32()), pa.array([most] * len(made), pa.int32()), pa.array([m.ravel() for m in made], pa.list_(pa.float32()))], ["file_id", "bins", "columns", "features"]
            )

    return signals.select("file_id", "samples").mapInArrow(run, f"file_id {signals.schema['file_id'].dataType.simpleString()}, bins int, columns int, features array<float>")
