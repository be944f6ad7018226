"""Functions on positions and intervals, all half-open and in whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklane.schemas import SAMPLE_RATE, US


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Length that both intervals cover; touching ones share nothing."""
    return F.greatest(F.least(end_a, end_b) - F.greatest(start_a, start_b), F.lit(0).cast("long"))


def length(start: Column, end: Column) -> Column:
    """0 for an interval that ends before it starts."""
    return F.greatest(end - start, F.lit(0).cast("long"))


def frame_position(frame: Column, frame_samples: Column | int, total: Column) -> Column:
    return F.least(frame * frame_samples, total)


def samples_of_ms(ms: Column) -> Column:
    return F.floor(ms * SAMPLE_RATE / 1000).cast("long")


def us_of_samples(samples: Column) -> Column:
    """62.5 microseconds each, rounded down."""
    return F.floor(samples * (US // 1000) / (SAMPLE_RATE // 1000)).cast("long")


def seconds(us: Column) -> Column:
    return F.round(us / US, 6)
