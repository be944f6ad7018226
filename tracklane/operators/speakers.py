"""Giving words to the speakers whose turns cover them, and splitting segments where the speaker changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklane.functions.text import join_words
from tracklane.functions.times import overlap
from tracklane.schemas import US

#: Both sides of the interval join are dealt into bins of this length, so that no word meets all turns of a long file.
BIN_US = 60 * US


def assigned(words: DataFrame, turns: DataFrame, key: tuple[str, ...] = ("file_id", "word_id"), bin_us: int = BIN_US) -> DataFrame:
    """(key, speaker) of every word that a turn overlaps.

    ``words``: key, start_us, end_us; ``turns``: file_id, start_us, end_us, speaker. A speaker's overlaps add up; the
    most wins, then the earliest of the overlapping turns, then the least speaker. Empty words and turns that end before
    they start match nothing. A pair is accepted in one bin only, the one that holds the later of the two starts.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(s / bin_us), F.floor((e - 1) / bin_us)))
    w = words.filter("end_us > start_us").select(*key, F.col("start_us").alias("ws"), F.col("end_us").alias("we"), bins(F.col("start_us"), F.col("end_us")).alias("bin"))
    t = turns.filter("end_us > start_us").select("file_id", F.col("start_us").alias("ts"), F.col("end_us").alias("te"), "speaker", bins(F.col("start_us"), F.col("end_us")).alias("bin"))
    met = w.join(t, ["file_id", "bin"]).filter("ws < te and ts < we").filter(F.col("bin") == F.floor(F.greatest("ws", "ts") / bin_us))
    sums = met.groupBy(*key, "speaker").agg(F.sum(overlap(F.col("ws"), F.col("we"), F.col("ts"), F.col("te"))).alias("total"), F.min("ts").alias("first"))
    return sums.groupBy(*key).agg(F.min_by("speaker", F.struct(-F.col("total"), "first", "speaker")).alias("speaker"))


def _named(words: DataFrame, turns: DataFrame, carried: list[str], bin_us: int = BIN_US) -> DataFrame:
    """``words`` (file_id, seg_id, pos and the carried columns) with ``speaker``, by the rule of ``assigned``."""
    bin_of = lambda x: F.floor(x / bin_us)
    key = ["file_id", "seg_id", "pos"]
    w = words.select(*key, *carried, F.explode(F.sequence(bin_of(F.col("start_us")), bin_of(F.greatest(F.col("end_us") - 1, "start_us")))).alias("bin"))
    t = turns.filter("end_us > start_us").select(F.col("file_id").alias("of"), F.col("start_us").alias("ts"), F.col("end_us").alias("te"), "speaker", F.explode(F.sequence(bin_of(F.col("start_us")), bin_of(F.col("end_us") - 1))).alias("at"))
    later = F.greatest("start_us", "ts")
    meets = (F.col("file_id") == F.col("of")) & (F.col("bin") == F.col("at")) & (F.col("start_us") < F.col("te")) & (F.col("ts") < F.col("end_us")) & (F.col("start_us") < F.col("end_us")) & (F.col("bin") == bin_of(later))
    dealt = w.join(t, meets, "left").repartition("file_id", "seg_id")
    firsts = [F.first(c).alias(c) for c in carried]
    sums = dealt.groupBy(*key, "speaker").agg(F.sum(overlap(F.col("start_us"), F.col("end_us"), F.col("ts"), F.col("te"))).alias("total"), F.min("ts").alias("first"), *firsts)
    best = F.min_by("speaker", F.when(F.col("speaker").isNotNull(), F.struct(-F.col("total"), "first", "speaker"))).alias("speaker")
    return sums.groupBy(*key).agg(best, *firsts)


def runs(words: DataFrame) -> DataFrame:
    """``words`` (file_id, seg_id, pos, speaker, ...) with ``run`` from 0: a run ends where the speaker changes."""
    by = Window.partitionBy("file_id", "seg_id").orderBy("pos")
    change = (~F.col("speaker").eqNullSafe(F.lag("speaker").over(by)) & (F.lag("pos").over(by).isNotNull())).cast("int")
    return words.withColumn("change", change).withColumn("run", F.sum("change").over(by)).drop("change")


def split_segments(segments: DataFrame, turns: DataFrame | None) -> DataFrame:
    """(file_id, seg_id, run, start_us, end_us, text, words, speaker).

    A segment with one speaker throughout keeps its text and bounds. Where speakers alternate it is split into runs,
    with bounds of the first and last word and the text of the words. Segments with null or no words pass through
    without a speaker. ``words`` of each word have the speaker too.
    """
    spoken = segments.filter(F.size("words") > 0)
    exploded = spoken.select("file_id", "seg_id", F.col("start_us").alias("seg_start"), F.col("end_us").alias("seg_end"), F.col("text").alias("seg_text"), F.posexplode("words").alias("pos", "w")).select("*", "w.*")
    out = split_words(exploded, turns)
    kind = out.schema["words"].dataType
    silent = segments.filter(F.col("words").isNull() | (F.size("words") == 0)).select(
        "file_id", "seg_id", F.lit(0).cast("long").alias("run"), "start_us", "end_us", "text", F.when(F.col("words").isNotNull(), F.array().cast(kind)).alias("words"), F.lit(None).cast("long").alias("speaker")
    )
    return out.unionByName(silent)


def split_words(exploded: DataFrame, turns: DataFrame | None) -> DataFrame:
    """The same for words as rows: file_id, seg_id, pos, start_us, end_us, word, probability.

    Also seg_start, seg_end and seg_text, where a segment's own bounds and text aren't those of its words, joined by
    spaces. After the interval join words are dealt by segment once, for all that follows.
    """
    whole = [c for c in ("seg_start", "seg_end", "seg_text") if c in exploded.columns]
    named = exploded.withColumn("speaker", F.lit(None).cast("long")) if turns is None else _named(exploded, turns, [*whole, "start_us", "end_us", "word", "probability"])
    word = F.struct("pos", "start_us", "end_us", "word", "probability", "speaker")
    grouped = runs(named).groupBy("file_id", "seg_id", "run").agg(
        F.array_sort(F.collect_list(word)).alias("ws"), F.first("speaker").alias("speaker"), *(F.first(c).alias(c) for c in whole)
    )
    alone = F.count("*").over(Window.partitionBy("file_id", "seg_id")) == 1
    ws = F.col("ws")
    if not whole:
        grouped = grouped.withColumns({"seg_start": ws[0]["start_us"], "seg_end": F.element_at(ws, -1)["end_us"], "seg_text": F.array_join(F.transform(ws, lambda w: w["word"]), " ")})
    return grouped.withColumn("alone", alone).select(
        "file_id", "seg_id", "run",
        F.when(F.col("alone"), F.col("seg_start")).otherwise(ws[0]["start_us"]).alias("start_us"),
        F.when(F.col("alone"), F.col("seg_end")).otherwise(F.element_at(ws, -1)["end_us"]).alias("end_us"),
        F.when(F.col("alone"), F.col("seg_text")).otherwise(join_words(F.transform(ws, lambda w: w["word"]))).alias("text"),
        F.transform(ws, lambda w: F.struct(w["start_us"].alias("start_us"), w["end_us"].alias("end_us"), w["word"].alias("word"), w["probability"].alias("probability"), w["speaker"].alias("speaker"))).alias("words"),
        "speaker",
    )


def speaker_counts(files: DataFrame, turns: DataFrame) -> DataFrame:
    """(file_id, num_speakers): distinct speakers among the turns, 0 for a file without any."""
    found = turns.groupBy("file_id").agg(F.count_distinct("speaker").alias("n"))
    return files.join(found, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0)).cast("long").alias("num_speakers"))
