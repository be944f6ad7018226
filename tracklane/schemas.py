"""Schemas and constants. Positions are whole samples, times whole microseconds; seconds appear in results only."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values
SAMPLE_RATE = 16_000
WINDOW_SAMPLES = 480_000
CUT_SEARCH_SAMPLES = 32_000
FRAMES_PER_SECOND = 50.0
DEFAULT_MAX_SPEAKERS = 8
BINARY_FRAME_SAMPLES = 480
GRADED_FRAME_SAMPLES = 512
US = 1_000_000


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


FRAMES = _struct(file_id=T.StringType(), frame=T.LongType(), p=T.DoubleType())
REGIONS = _struct(file_id=T.StringType(), region_id=T.LongType(), start_sample=T.LongType(), end_sample=T.LongType())
WINDOWS = _struct(file_id=T.StringType(), window_id=T.LongType(), offset=T.LongType(), real_len=T.LongType())
WORD = _struct(start=T.DoubleType(), end=T.DoubleType(), word=T.StringType(), probability=T.DoubleType(), speaker=T.LongType())
WORD_US = _struct(start_us=T.LongType(), end_us=T.LongType(), word=T.StringType(), probability=T.DoubleType(), speaker=T.LongType())
RAW_SEGMENTS = _struct(file_id=T.StringType(), window_id=T.LongType(), seg_id=T.LongType(), start_us=T.LongType(), end_us=T.LongType(), text=T.StringType(), words=T.ArrayType(WORD_US))
SEGMENTS = _struct(file_id=T.StringType(), id=T.LongType(), start=T.DoubleType(), end=T.DoubleType(), text=T.StringType(), words=T.ArrayType(WORD), speaker=T.LongType())
TURNS = _struct(file_id=T.StringType(), start_us=T.LongType(), end_us=T.LongType(), speaker=T.LongType())
INFO = _struct(file_id=T.StringType(), language=T.StringType(), language_probability=T.DoubleType(), duration=T.DoubleType(), duration_after_vad=T.DoubleType(), num_speakers=T.LongType())
SIGNALS = _struct(file_id=T.StringType(), sample_rate=T.IntegerType(), samples=T.ArrayType(T.FloatType()))
