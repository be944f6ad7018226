"""From emitted tokens to raw segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_segments(tokens: DataFrame, words: bool = True) -> DataFrame:
    """(file_id, window_id, seg_id, start_us, end_us, text, words): one segment for each window with a token.

    ``tokens``: file_id, window_id, pos, start_us, end_us, piece. It starts with the first token and ends with the last
    one by position, whatever times lie between. Tokens are words of probability 1 if words are wanted, else null; the
    text is the tokens with single spaces. A null piece counts as empty; equal positions go by time.
    """
    place = F.struct("pos", "start_us", "end_us")
    token = F.struct("pos", "start_us", "end_us", F.coalesce("piece", F.lit("")).alias("word"))
    rows = tokens.groupBy("file_id", "window_id").agg(F.min_by("start_us", place).alias("start_us"), F.max_by("end_us", place).alias("end_us"), F.array_sort(F.collect_list(token)).alias("ts"))
    listed = F.transform("ts", lambda t: F.struct(t["start_us"].alias("start_us"), t["end_us"].alias("end_us"), t["word"].alias("word"), F.lit(1.0).alias("probability")))
    return rows.select(
        "file_id", "window_id", F.lit(0).cast("long").alias("seg_id"), "start_us", "end_us", F.array_join(F.transform("ts", lambda t: t["word"]), " ").alias("text"),
        F.when(F.lit(words), listed).alias("words"),
    )
