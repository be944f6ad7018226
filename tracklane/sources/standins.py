"""Timed sequences derived from the driver's tables, since there is no audio; each has its SQL beside it.

They stand in for frame scores, words, turns and segments, and are not speech. Every query and its SQL start from these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word's share of the timeline and its length, how far turns are shifted into the words, and words in a segment.
WORD_STEP_US, WORD_US, SHIFT_US, SEGMENT_WORDS = 300_000, 250_000, 130_000, 20
FRAME, COARSE_FRAME, COARSE_FILES = 1_600, 16_000, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """(file_id, frame, p, total): an event is a frame, a user (or a tenth of all users) a file."""
    key = F.col("user_id") % COARSE_FILES if coarse else F.col("user_id")
    rows = table(spark, sf_dir, "events").select(key.alias("file_id"), "ts", "event_id", F.least(F.col("value") / 100, F.lit(1.0)).alias("p"))
    by = Window.partitionBy("file_id")
    numbered = rows.withColumns({"frame": (F.row_number().over(by.orderBy("ts", "event_id")) - 1).cast("long"), "total": F.count("*").over(by) * (COARSE_FRAME if coarse else FRAME)})
    return numbered.select("file_id", "frame", "p", "total")


FRAMES_SQL = """frames AS (
  SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
         least(value / 100, 1.0) AS p, count(*) OVER (PARTITION BY user_id) * 1600 AS total, 1600 AS step FROM events)"""
COARSE_SQL = """frames AS (
  SELECT user_id % 10 AS file_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS frame,
         least(value / 100, 1.0) AS p, count(*) OVER (PARTITION BY user_id % 10) * 16000 AS total, 16000 AS step FROM events)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, turn, role, word, word_id from 0 in the file, start_us, end_us): words of a conversation in order."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), "turn", "role", F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("pos", "word"))
    word = F.row_number().over(Window.partitionBy("file_id").orderBy("turn", "pos")) - 1
    numbered = rows.withColumn("word_id", word.cast("long"))
    return numbered.select("file_id", "turn", "role", "word", "word_id", (F.col("word_id") * WORD_STEP_US).alias("start_us"), (F.col("word_id") * WORD_STEP_US + WORD_US).alias("end_us"))


WORDS_SQL = """split AS (
  SELECT conv_id AS file_id, turn, role, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS word,
         unnest(generate_series(1, len(list_filter(string_split(text, ' '), lambda x: x <> '')))) AS pos FROM conversations),
words AS (
  SELECT file_id, turn, role, word, word_id, word_id * 300000 AS start_us, word_id * 300000 + 250000 AS end_us, word_id // 20 AS seg_id
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY turn, pos) - 1 AS word_id FROM split))"""


def turns(spoken: DataFrame) -> DataFrame:
    """(file_id, start_us, end_us, speaker) from ``words``: a turn's extent, shifted so that its bounds cut words."""
    code = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2).cast("long")
    return spoken.groupBy("file_id", "turn").agg((F.min("start_us") + SHIFT_US).alias("start_us"), (F.max("end_us") + SHIFT_US).alias("end_us"), F.min(code).alias("speaker")).drop("turn")


TURNS_SQL = """turns AS (
  SELECT file_id, min(start_us) + 130000 AS start_us, max(end_us) + 130000 AS end_us,
         min(CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END) AS speaker FROM words GROUP BY file_id, turn)"""


def segments(spoken: DataFrame) -> DataFrame:
    """(file_id, seg_id, start_us, end_us, text, words) from ``words``: twenty words each, whoever speaks."""
    word = F.struct("word_id", "start_us", "end_us", "word", F.lit(1.0).alias("probability"))
    rows = spoken.groupBy("file_id", F.floor(F.col("word_id") / SEGMENT_WORDS).alias("seg_id")).agg(F.array_sort(F.collect_list(word)).alias("ws"))
    plain = F.transform("ws", lambda w: F.struct(w["start_us"].alias("start_us"), w["end_us"].alias("end_us"), w["word"].alias("word"), w["probability"].alias("probability")))
    return rows.select("file_id", "seg_id", F.col("ws")[0]["start_us"].alias("start_us"), F.element_at("ws", -1)["end_us"].alias("end_us"), F.array_join(F.transform("ws", lambda w: w["word"]), " ").alias("text"), plain.alias("words"))


def segment_words(spoken: DataFrame) -> DataFrame:
    """The same segments as a row for each word: file_id, seg_id, pos, start_us, end_us, word, probability."""
    seg = F.floor(F.col("word_id") / SEGMENT_WORDS)
    return spoken.select("file_id", seg.alias("seg_id"), (F.col("word_id") - seg * SEGMENT_WORDS).cast("int").alias("pos"), "start_us", "end_us", "word", F.lit(1.0).alias("probability"))


def tokens(spoken: DataFrame) -> DataFrame:
    """(file_id, window_id, pos, start_us, end_us, piece) from ``words``: a turn is a window, times don't follow positions."""
    late = (F.col("word_id") % 3) * 400_000
    return spoken.select("file_id", F.col("turn").cast("long").alias("window_id"), F.col("word_id").alias("pos"), (F.col("start_us") + late).alias("start_us"), (F.col("end_us") + late).alias("end_us"), F.col("word").alias("piece"))


def local_segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Windows (file_id, window_id, offset_us, real_us) and segments with times from the window's start.

    A turn is a window of thirty seconds, real for a fifth of a second per word; ten words are a segment, and a word
    takes 0.3 s, so that later ones fall into the padding.
    """
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("window_id"), F.filter(F.split("text", " "), lambda w: w != "").alias("ws"))
    windows = rows.select("file_id", "window_id", (F.col("window_id") * 30_000_000).alias("offset_us"), F.least(F.size("ws").cast("long") * 200_000, F.lit(30_000_000)).alias("real_us"))
    made = rows.filter(F.size("ws") > 0).select("file_id", "window_id", "ws", F.explode(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / 10).cast("int"))).alias("k"))
    part = F.slice("ws", F.col("k") * 10 + 1, 10)
    at = lambda i: (F.col("k").cast("long") * 10 + i) * WORD_STEP_US
    listed = F.transform(part, lambda w, i: F.struct(at(i).alias("start_us"), (at(i) + WORD_US).alias("end_us"), w.alias("word"), F.lit(1.0).alias("probability")))
    return windows, made.select("file_id", "window_id", F.col("k").cast("long").alias("seg_id"), at(F.lit(0)).alias("start_us"), (at(F.size(part) - 1) + WORD_US).alias("end_us"), F.array_join(part, " ").alias("text"), listed.alias("words"))
