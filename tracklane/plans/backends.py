"""Where models are plugged in: scorers of frames, recognisers of windows, and diarisers of files.

None is bundled but two scorers by loudness, one that says yes or no (the default) and a graded one, and speaker
labels by clustering of embeddings that a backend makes. What isn't registered is an error when it is asked for, never left out.
A factory is called once in a Python worker and its backend kept for all batches that the worker gets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from tracklane.errors import BackendError
from tracklane.operators.clustering import labels_of
from tracklane.operators.signal import arrays
from tracklane.schemas import BINARY_FRAME_SAMPLES, SAMPLE_RATE, US


class Scorer(Protocol):
    frame_samples: int
    graded: bool

    def probabilities(self, samples: np.ndarray) -> np.ndarray: ...


class Recogniser(Protocol):
    def transcribe(self, samples: np.ndarray, language: str | None, words: bool) -> list[dict]:
        """Segments with start and end in seconds from the window's start, text, and words likewise or None."""

    def detect_language(self, samples: np.ndarray) -> tuple[str, float]: ...


class Diariser(Protocol):
    def turns(self, samples: np.ndarray, max_speakers: int, num_speakers: int | None) -> list[tuple[float, float, int]]: ...


class Loudness:
    """0.9 for a frame whose peak exceeds 0.1, else 0."""

    graded = True

    def __init__(self, frame_samples: int = 512):
        self.frame_samples = frame_samples

    def probabilities(self, samples: np.ndarray) -> np.ndarray:
        n = -(-len(samples) // self.frame_samples)
        full = np.zeros(n * self.frame_samples, np.float32)
        full[: len(samples)] = samples
        return np.where(np.abs(full.reshape(n, self.frame_samples)).max(1, initial=0) > 0.1, 0.9, 0.0)


class Gate:
    """1 for a frame that stands out from the noise, else 0; the estimate of the noise goes on from frame to frame.

    Frames are 16-bit, as such detectors take them. A frame stands out if its mean square is over LEAST and over RATIO
    times that of the noise, which follows the frames that don't.
    """

    graded = False
    LEAST, RATIO, FOLLOW = 500.0**2, 6.0, 0.05

    def __init__(self, frame_samples: int = BINARY_FRAME_SAMPLES):
        self.frame_samples = frame_samples

    def probabilities(self, samples: np.ndarray) -> np.ndarray:
        n = -(-len(samples) // self.frame_samples)
        full = np.zeros(n * self.frame_samples, np.float64)
        full[: len(samples)] = np.trunc(np.clip(samples, -1, 1) * 32767)
        power = (full.reshape(n, self.frame_samples) ** 2).mean(1)
        out, noise = np.zeros(n), self.LEAST / self.RATIO
        for i, p in enumerate(power.tolist()):
            if p > self.LEAST and p > self.RATIO * noise:
                out[i] = 1.0
            else:
                noise += self.FOLLOW * (p - noise)
        return out


_registered: dict[str, Callable[..., Any]] = {"scorer": Gate}
_made: dict[Any, Any] = {}


def register(kind: str, factory: Callable[..., Any] | None) -> None:
    """``kind``: scorer, recogniser or diariser; None takes it back."""
    if factory is None:
        _registered.pop(kind, None)
    else:
        _registered[kind] = factory


def factory(kind: str) -> Callable[..., Any]:
    if kind not in _registered:
        raise BackendError(f"no {kind} is registered; call tracklane.plans.backends.register({kind!r}, factory)")
    return _registered[kind]


def _backend(make: Callable[..., Any], *args) -> Any:
    """One for an equal factory and equal arguments in a worker: it is built anew only if one of them differs."""
    key = cloudpickle.dumps((make, args))
    if key not in _made:
        _made[key] = make(*args)
    return _made[key]


def scored(signals: DataFrame, make: Callable[[], Scorer]) -> DataFrame:
    """(file_id, frame, p, total): a scorer can carry state, so a file is scored in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _backend(make)
        for batch in batches:
            for name, samples in zip(batch.column(0).to_pylist(), arrays(batch.column(1)), strict=True):
                p = scorer.probabilities(samples)
                n = len(p)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n)), pa.array(np.asarray(p, float)), pa.array(np.full(n, len(samples)))], ["file_id", "frame", "p", "total"])

    return signals.select("file_id", "samples").mapInArrow(run, "file_id string, frame long, p double, total long")


_WORDS = pa.list_(pa.struct([("start_us", pa.int64()), ("end_us", pa.int64()), ("word", pa.string()), ("probability", pa.float64())]))


def recognised(windows: DataFrame, make: Callable[..., Recogniser], args: tuple, words: bool) -> DataFrame:
    """Raw segments of each window (file_id, window_id, samples, language); windows don't depend on one another."""

    def us(seconds: float) -> int:
        return round(seconds * US)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _backend(make, *args)
        for batch in batches:
            names, ids, languages = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for name, window, samples, language in zip(names, ids, arrays(batch.column(2)), languages, strict=True):
                found = model.transcribe(samples, language, words)
                if not found:
                    continue
                listed = [None if s.get("words") is None or not words else [{"start_us": us(w["start"]), "end_us": us(w["end"]), "word": w["word"], "probability": float(w.get("probability", 1.0))} for w in s["words"]] for s in found]
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array([window] * n, pa.int64()), pa.array(np.arange(n)), pa.array([us(s["start"]) for s in found], pa.int64()), pa.array([us(s["end"]) for s in found], pa.int64()), pa.array([s["text"] for s in found]), pa.array(listed, _WORDS)],
                    ["file_id", "window_id", "seg_id", "start_us", "end_us", "text", "words"],
                )

    schema = "file_id string, window_id long, seg_id long, start_us long, end_us long, text string, words array<struct<start_us: long, end_us: long, word: string, probability: double>>"
    return windows.select("file_id", "window_id", "samples", "language").mapInArrow(run, schema)


def languages(windows: DataFrame, make: Callable[..., Recogniser], args: tuple) -> DataFrame:
    """(file_id, window_id, language, probability) of the given windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _backend(make, *args)
        for batch in batches:
            found = [model.detect_language(s) for s in arrays(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([float(f[1]) for f in found], pa.float64())], ["file_id", "window_id", "language", "probability"])

    return windows.select("file_id", "window_id", "samples").mapInArrow(run, "file_id string, window_id long, language string, probability double")


def turns_of(signals: DataFrame, make: Callable[[], Diariser], max_speakers: int, num_speakers: int | None) -> DataFrame:
    """(file_id, start_us, end_us, speaker): speakers are told apart over the whole file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _backend(make)
        for batch in batches:
            for name, samples in zip(batch.column(0).to_pylist(), arrays(batch.column(1)), strict=True):
                found = model.turns(samples, max_speakers, num_speakers)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), *(pa.array([round(t[i] * US) for t in found], pa.int64()) for i in (0, 1)), pa.array([t[2] for t in found], pa.int64())], ["file_id", "start_us", "end_us", "speaker"])

    return signals.select("file_id", "samples").mapInArrow(run, "file_id string, start_us long, end_us long, speaker long")


class Embedded:
    """A diariser from a backend's embeddings: ``embed(samples)`` gives (start, end, vector) for stretches of speech.

    With a number of speakers there are exactly as many (fewer if there are fewer stretches); without, as many as
    average linkage leaves apart, and ``max_speakers`` at most. Stretches of one speaker that touch become one turn.
    """

    def __init__(self, embed: Callable[[np.ndarray], list[tuple[float, float, np.ndarray]]]):
        self.embed = embed

    def turns(self, samples: np.ndarray, max_speakers: int, num_speakers: int | None) -> list[tuple[float, float, int]]:
        found = sorted(self.embed(samples), key=lambda x: x[:2])
        if not found:
            return []
        out: list[tuple[float, float, int]] = []
        for (start, end, _), k in zip(found, labels_of(np.array([v for *_, v in found], float), num_speakers, max_speakers), strict=True):
            if out and out[-1][2] == k and start <= out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]), int(k))
            else:
                out.append((start, end, int(k)))
        return out


def by_band(samples: np.ndarray) -> list[tuple[float, float, np.ndarray]]:
    """Embeddings for tests: half-second stretches above a peak of 0.1, as a direction by their zero crossings."""
    step = SAMPLE_RATE // 2
    out = []
    for i in range(0, len(samples), step):
        part = samples[i : i + step]
        if np.abs(part).max() > 0.1:
            turn = np.pi * min(1.0, float(np.mean(np.diff(np.sign(part)) != 0)) * 5)
            out.append((i / SAMPLE_RATE, (i + len(part)) / SAMPLE_RATE, np.array([np.cos(turn), np.sin(turn)])))
    return out


def ByBand() -> Embedded:
    """A diariser for tests."""
    return Embedded(by_band)
