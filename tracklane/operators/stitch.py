"""From window-local segments to one timeline per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklane.functions.text import is_blank


def stitched(windows: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments on the file's timeline, in microseconds.

    ``windows``: file_id, window_id, offset_us, real_us. ``segments``: file_id, window_id, seg_id, start_us, end_us,
    text, words. Segments that start in a window's padding, and blank ones, go, and words likewise; a list of words of
    which none is left, or that came empty, is null. Ends are held within the window, starts aren't.
    """
    real, offset = F.col("real_us"), F.col("offset_us")
    here = segments.join(windows, ["file_id", "window_id"]).filter((F.col("start_us") < real) & ~is_blank(F.col("text")))
    moved = lambda w: F.struct((w["start_us"] + offset).alias("start_us"), F.least(w["end_us"] + offset, offset + real).alias("end_us"), w["word"].alias("word"), w["probability"].alias("probability"))
    kept = F.transform(F.filter("words", lambda w: w["start_us"] < real), moved)
    return here.select(
        "file_id", "window_id", "seg_id", (F.col("start_us") + offset).alias("start_us"), F.least(F.col("end_us") + offset, offset + real).alias("end_us"), "text", F.when(F.size(kept) > 0, kept).alias("words")
    )


def numbered(segments: DataFrame, *order: str) -> DataFrame:
    """``segments`` with ids from 0 without gaps within each file, in the given order."""
    return segments.withColumn("id", (F.row_number().over(Window.partitionBy("file_id").orderBy(*order)) - 1).cast("long"))
