"""The whole dataflow: signals, scores, regions, windows, recognition, one timeline, speakers, numbered segments.

Recognition itself is a backend's; see ``backends``. Stages are DataFrames; nothing runs until rows are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane import params
from tracklane.errors import AudioError
from tracklane.functions.text import chosen_language, decoder_language
from tracklane.functions.times import seconds, us_of_samples
from tracklane.operators import language as languages
from tracklane.operators import regions, speakers, stitch, windows
from tracklane.plans import backends
from tracklane.plans.registry import ensure_model
from tracklane.sources.audio import signals
from tracklane.sources.shipping import ship


@dataclass(frozen=True)
class Word:
    start: float
    end: float
    word: str
    probability: float
    speaker: int | None = None

    def __repr__(self) -> str:
        return f"Word(start={self.start:.2f}, end={self.end:.2f}, word={self.word!r})"


@dataclass(frozen=True)
class Segment:
    id: int
    start: float
    end: float
    text: str
    words: list[Word] | None = None
    speaker: int | None = None

    def __repr__(self) -> str:
        return f"Segment(id={self.id}, start={self.start:.2f}, end={self.end:.2f}, text={self.text!r})"


@dataclass(frozen=True)
class TranscriptionInfo:
    language: str
    language_probability: float | None
    duration: float
    duration_after_vad: float
    num_speakers: int | None

    def __repr__(self) -> str:
        return f"TranscriptionInfo(language={self.language!r}, duration={self.duration:.2f}, duration_after_vad={self.duration_after_vad:.2f})"


class SegmentIterator:
    """Segments of one file in order, fetched partition by partition as they are asked for.

    ``held``: the signals they are made from, which are let go after the last segment.
    """

    def __init__(self, rows: DataFrame, held: DataFrame | None = None):
        self.rows = rows
        self.inner: Iterator | None = None
        self.held = held

    def __iter__(self) -> SegmentIterator:
        return self

    def __next__(self) -> Segment:
        if self.inner is None:
            self.inner = self.rows.orderBy("id").toLocalIterator()
        try:
            r = next(self.inner)
        except StopIteration:
            if self.held is not None:
                self.held.unpersist()
            raise
        words = None if r["words"] is None else [Word(w["start"], w["end"], w["word"], w["probability"], w["speaker"]) for w in r["words"]]
        return Segment(r["id"], r["start"], r["end"], r["text"], words, r["speaker"])


class _Model:
    streaming = False

    def __init__(self, model: str, spark: SparkSession | None, local_files_only: bool, fetch):
        self.model_path = ensure_model(model, local_files_only, self.streaming, fetch)
        self.spark = ship(spark or SparkSession.builder.getOrCreate())

    def run(self, files: DataFrame, pinned: str | None, args: tuple, words: bool, vad_filter: bool, region: params.RegionParams, diarize: bool, max_speakers: int, num_speakers: int | None, auto: bool = False) -> tuple[DataFrame, DataFrame]:
        """(segments, info) of all files, a DataFrame each."""
        make = backends.factory("recogniser")
        lengths = files.select("file_id", F.size("samples").cast("long").alias("total"))
        frames, step = None, 0
        if vad_filter:
            scorer = backends.factory("scorer")
            step = scorer().frame_samples
            region = params.RegionParams(region.threshold, region.neg_threshold, region.min_speech_ms, region.min_silence_ms, region.speech_pad_ms, step)
            frames = backends.scored(files, scorer)
            found = regions.regions(frames, region)
        else:
            found = regions.whole_files(lengths)
        planned = windows.windows(found, frames, step)
        made = windows.materialised(planned, files)
        if pinned is None:
            first = made.filter("window_id = 0")
            spoken = languages.file_language(lengths, backends.languages(first, make, args))
        else:
            spoken = languages.file_language(lengths, made, pinned)
        told = decoder_language(F.col("language")) if auto else F.col("language")
        raw = backends.recognised(made.join(spoken.select("file_id", told.alias("language")), "file_id"), make, args, words)
        spans = planned.join(lengths, "file_id").select(
            "file_id", "window_id", us_of_samples(F.col("start_sample")).alias("offset_us"), us_of_samples(F.least("end_sample", "total") - F.least("start_sample", "total")).alias("real_us")
        )
        timed = stitch.stitched(spans, raw)
        unique = timed.withColumn("seg_id", F.col("window_id") * (1 << 24) + F.col("seg_id"))
        turns = backends.turns_of(files, backends.factory("diariser"), max_speakers, num_speakers) if diarize else None
        split = stitch.numbered(speakers.split_segments(unique, turns), "seg_id", "run")
        out = split.select("file_id", "id", seconds(F.col("start_us")).alias("start"), seconds(F.col("end_us")).alias("end"), "text",
                           F.transform("words", lambda w: F.struct(seconds(w["start_us"]).alias("start"), seconds(w["end_us"]).alias("end"), w["word"].alias("word"), w["probability"].alias("probability"), w["speaker"].alias("speaker"))).alias("words"), "speaker")
        info = spoken.join(regions.totals(lengths, found), "file_id")
        counts = speakers.speaker_counts(lengths, turns) if diarize else lengths.select("file_id", F.lit(None).cast("long").alias("num_speakers"))
        return out, info.join(counts, "file_id")

    def signals_of(self, audio: str | DataFrame) -> DataFrame:
        """Signals of a path are decoded once and held: lengths, scores, windows, turns and times all need them."""
        return signals(self.spark, audio).persist(StorageLevel.MEMORY_AND_DISK) if isinstance(audio, str) else audio

    def one(self, audio: str, files: DataFrame, out: tuple[DataFrame, DataFrame]) -> tuple[SegmentIterator, TranscriptionInfo]:
        found = out[1].limit(2).collect()
        if len(found) != 1:
            files.unpersist()
            raise AudioError(f"{audio} names {'several files' if found else 'no file'}; give many files as a DataFrame of signals")
        r = found[0]
        return SegmentIterator(out[0], files), TranscriptionInfo(r["language"], r["language_probability"], r["duration"], r["duration_after_vad"], r["num_speakers"])


class SpeechModel(_Model):
    """A recogniser of windows. ``transcribe`` takes a path, or a DataFrame of signals for many files at once."""

    def __init__(self, model: str, *, device: str = "cpu", device_index: int = 0, compute_type: str = "default", cpu_threads: int = 0, num_workers: int = 1, download_root: str | None = None, local_files_only: bool = False, spark: SparkSession | None = None, fetch=None):
        self.config = (params.checked_device(device), [device_index] * max(num_workers, 1), params.checked_compute_type(compute_type), cpu_threads, download_root)
        super().__init__(model, spark, local_files_only, fetch)

    def transcribe(
        self, audio: str | DataFrame, *, language: str | None = None, task: str = "transcribe", beam_size: int = 5, patience: float = 1.0, length_penalty: float = 1.0, temperature: float = 0.0,
        repetition_penalty: float = 1.0, no_repeat_ngram_size: int = 0, max_initial_timestamp: float = 1.0, suppress_blank: bool = True, word_timestamps: bool | None = None, vad_filter: bool = True,
        vad_parameters: dict | None = None, diarize: bool = False, max_speakers: int = params.DEFAULT_MAX_SPEAKERS, num_speakers: int | None = None,
    ):
        params.checked_task(task)
        params.checked_speakers(diarize, max_speakers, num_speakers)
        words = params.word_timestamps(word_timestamps, diarize)
        region = params.RegionParams.of(vad_parameters, getattr(backends.factory("scorer"), "graded", False))
        options = params.DecodeOptions(beam_size, patience, length_penalty, temperature, repetition_penalty, no_repeat_ngram_size, max_initial_timestamp, suppress_blank)
        files = self.signals_of(audio)
        out = self.run(files, language, (self.model_path, self.config, options), words, vad_filter, region, diarize, max_speakers, num_speakers)
        return self.one(audio, files, out) if isinstance(audio, str) else out


class StreamingModel(_Model):
    """A recogniser without decode options. A language named in the call goes before the configured one."""

    streaming = True

    def __init__(self, model: str, *, download_root: str | None = None, local_files_only: bool = False, target_lang: str | None = None, spark: SparkSession | None = None, fetch=None):
        self.target_lang, self.download_root = target_lang, download_root
        super().__init__(model, spark, local_files_only, fetch)

    def wanted(self, language: str | None) -> str | None:
        """The call's language, else the configured one, else null: to be detected. The same rule for a column of
        requests is ``functions.text.chosen_language``."""
        return self.target_lang if language is None else language

    def transcribe(
        self, audio: str | DataFrame, *, language: str | None = None, word_timestamps: bool | None = None, vad_filter: bool = True, vad_parameters: dict | None = None, diarize: bool = False,
        max_speakers: int = params.DEFAULT_MAX_SPEAKERS, num_speakers: int | None = None,
    ):
        params.checked_speakers(diarize, max_speakers, num_speakers)
        words = params.word_timestamps(word_timestamps, diarize)
        region = params.RegionParams.of(vad_parameters, getattr(backends.factory("scorer"), "graded", False))
        files = self.signals_of(audio)
        out = self.run(files, self.wanted(language), (self.model_path, self.target_lang), words, vad_filter, region, diarize, max_speakers, num_speakers, auto=True)
        return self.one(audio, files, out) if isinstance(audio, str) else out


__all__ = ["Segment", "SegmentIterator", "SpeechModel", "StreamingModel", "TranscriptionInfo", "Word", "chosen_language"]
