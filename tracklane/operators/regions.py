"""From frame scores to activity regions: hysteresis, duration filter, padding, merging.

All steps are window functions and aggregations over the file, which is also the only shuffle key: give the column its
name before the first of them, and one exchange serves all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklane.functions.times import frame_position, length
from tracklane.params import RegionParams, ms_to_samples
from tracklane.schemas import SAMPLE_RATE


def raw_regions(frames: DataFrame, params: RegionParams) -> DataFrame:
    """(file_id, total, start_sample, end_sample) of the stretches between opening and closing.

    ``frames``: file_id, frame from 0 without gaps, p, total samples. A score of at least ``threshold`` opens; one below
    ``neg_threshold`` starts a silence, or goes on with one, and the region closes, at the silence's start, once that
    reaches ``min_silence``. Scores between the two, and those that aren't numbers, change nothing. A region that is
    still open ends with the file.
    """
    step, least = params.frame_samples, ms_to_samples(params.min_silence_ms)
    speech = (F.col("p") >= params.threshold) & ~F.isnan("p")
    low = (F.col("p") < params.neg_threshold) & ~speech
    by = Window.partitionBy("file_id").orderBy("frame")
    position = lambda c: frame_position(c, step, F.col("total"))
    runs = (
        frames.withColumn("run", F.sum(speech.cast("int")).over(by)).filter("run > 0").groupBy("file_id", "run")
        .agg(F.min("frame").alias("first"), F.min(F.when(low, F.col("frame"))).alias("quiet"), F.max(F.when(low, F.col("frame"))).alias("quiet_last"), F.first("total").alias("total"))
    )  # a run is a speech frame and what follows it up to the next
    closes = F.col("quiet").isNotNull() & (position(F.col("quiet_last") + 1) - position(F.col("quiet")) >= least)
    before = Window.partitionBy("file_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    numbered = runs.withColumn("closes", closes).withColumn("region", F.coalesce(F.sum(F.col("closes").cast("int")).over(before), F.lit(0)))
    ends = F.max(F.when(F.col("closes"), position(F.col("quiet"))))
    return numbered.groupBy("file_id", "region").agg(F.first("total").alias("total"), F.min("first").alias("first"), ends.alias("closed")).select(
        "file_id", "total", position(F.col("first")).alias("start_sample"), F.coalesce("closed", "total").alias("end_sample")
    )


def long_enough(regions: DataFrame, params: RegionParams) -> DataFrame:
    """Regions of at least ``min_speech``, as they are before padding; empty ones go."""
    size = F.col("end_sample") - F.col("start_sample")
    return regions.filter((size >= ms_to_samples(params.min_speech_ms)) & (size > 0))


def padded(regions: DataFrame, params: RegionParams) -> DataFrame:
    pad = ms_to_samples(params.speech_pad_ms)
    return regions.withColumns({"start_sample": F.greatest(F.col("start_sample") - pad, F.lit(0).cast("long")), "end_sample": F.least(F.col("end_sample") + pad, F.col("total"))})


def merged(intervals: DataFrame, start: str = "start_sample", end: str = "end_sample", key: str = "file_id") -> DataFrame:
    """(key, region_id from 0, start, end): intervals that overlap or touch become one."""
    earlier = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    by = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = intervals.withColumn("opens", F.coalesce(F.col(start) > F.max(end).over(earlier), F.lit(True)).cast("int"))
    islands = opened.withColumn("region_id", F.sum("opens").over(by) - 1)
    return islands.groupBy(key, "region_id").agg(F.min(start).alias(start), F.max(end).alias(end))


def regions(frames: DataFrame, params: RegionParams) -> DataFrame:
    """(file_id, region_id, start_sample, end_sample), ascending and disjoint within a file."""
    return merged(padded(long_enough(raw_regions(frames, params), params), params))


def whole_files(files: DataFrame) -> DataFrame:
    """Without scoring, one region each; ``files``: file_id, total. Empty files have none."""
    zero = F.lit(0).cast("long")
    return files.filter("total > 0").select("file_id", zero.alias("region_id"), zero.alias("start_sample"), F.col("total").alias("end_sample"))


def totals(files: DataFrame, found: DataFrame) -> DataFrame:
    """(file_id, duration, duration_after_vad) in seconds; files without a region count 0 after."""
    speech = found.groupBy("file_id").agg(F.sum(length(F.col("start_sample"), F.col("end_sample"))).alias("speech"))
    return files.join(speech, "file_id", "left").select("file_id", (F.col("total") / SAMPLE_RATE).alias("duration"), (F.coalesce("speech", F.lit(0)) / SAMPLE_RATE).alias("duration_after_vad"))
