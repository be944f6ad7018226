"""One language per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.functions.text import language_tag


def file_language(files: DataFrame, scores: DataFrame, pinned: str | None = None) -> DataFrame:
    """(file_id, language, language_probability): the likeliest language of the first window, for the whole file.

    ``scores``: file_id, window_id, language, probability. A pinned language has a null probability; so has a file
    without windows, whose language is ``unknown``.
    """
    if pinned is not None:
        return files.select("file_id", F.lit(pinned).alias("language"), F.lit(None).cast("double").alias("language_probability"))
    best = scores.groupBy("file_id").agg(F.min_by(F.struct("language", "probability"), F.struct("window_id", -F.col("probability"), "language")).alias("best"))
    return files.join(best, "file_id", "left").select("file_id", F.coalesce("best.language", F.lit("unknown")).alias("language"), F.col("best.probability").alias("language_probability"))


def tagged_language(tokens: DataFrame, english_only: bool = False) -> DataFrame:
    """(file_id, language, probability) from emitted tokens (file_id, pos, piece, logprob): the first tag among them.

    Without one, ``unknown`` with probability 0; an English-only model is sure of ``en``.
    """
    if english_only:
        return tokens.select("file_id").distinct().select("file_id", F.lit("en").alias("language"), F.lit(1.0).alias("probability"))
    tag = language_tag(F.col("piece"))
    found = F.min_by(F.when(tag.isNotNull(), F.struct(tag.alias("tag"), F.exp("logprob").alias("p"))), F.when(tag.isNotNull(), F.col("pos")))
    return tokens.groupBy("file_id").agg(found.alias("f")).select("file_id", F.coalesce("f.tag", F.lit("unknown")).alias("language"), F.coalesce("f.p", F.lit(0.0)).alias("probability"))
