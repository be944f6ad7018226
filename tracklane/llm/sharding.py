"""Sharding by sampled splitters, in DataFrame operations only.

The key of a document is the crc32 of its text, so equal texts have equal keys. Keys are drawn with a chance in
proportion to a document's size; quantiles of the sample are the splitters, and records are partitioned into the
ranges between them. Ranges whose exact size turns out to be over their share are subdivided: by key, and a heavy key
(thousands of copies of one text) by document id. A heavy key's pieces go into one shard while it has room for them
all, the heaviest first; the other pieces, in key order, are then cut to fill the shards up to near-equal bytes. Only
(id, size, key) is ever shuffled, never a text.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.llm.common import documents, stored, utf8

RANGES = 1024
#: Keys drawn for each range, on average.
DRAWS = 32
#: Ranges and heavy keys are subdivided to pieces of about so many bytes of text and rows, however large the input is.
PIECE_BYTES, PIECE_ROWS = 64 << 20, 1 << 20
#: A heavy key may overfill a shard by this part of it rather than be split.
OVER = 0.01
KEYS = 1 << 32


def _range_of(key: Column, splitters: list[int]) -> Column:
    """The number of splitters up to the key. Equal cells of the key space point at the few splitters inside each."""
    cells = 1024
    width = KEYS // cells
    below, k = [], 0
    for c in range(cells + 1):
        while k < len(splitters) and splitters[k] < c * width:
            k += 1
        below.append(k)
    first, all_of_them = F.lit(below), F.lit(splitters or [KEYS])
    cell = (key / width).cast("int")
    at = F.element_at(first, cell + 1)
    inside = F.slice(all_of_them, at + 1, F.element_at(first, cell + 2) - at)
    return at + F.size(F.filter(inside, lambda s: s <= key))


def pinned(heavy: list[tuple[int, int]], total: int, shards: int) -> tuple[dict[int, int], list[float]]:
    """The shard of each heavy (key, bytes) that finds room for all of it, and the room that is left in each shard."""
    room = [total / shards] * shards
    place = {}
    for key, size in sorted(heavy, key=lambda x: (-x[1], x[0])):
        at = max(range(shards), key=lambda i: (room[i], -i))
        if size <= room[at] + OVER * total / shards:
            place[key] = at
            room[at] -= size
    return place, [max(0.0, x) for x in room]


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: id, size (UTF-8 bytes and one), key, shard from 0, slot gapless from 0 in the shard.

    Equal texts share a shard unless no shard has room for all of them. A null text counts as empty. Ids may be null or
    repeat. No rows give no rows. Other columns aren't read.
    """
    text = utf8(text_col)
    rows = stored(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("key")), "shard")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    heavy_bytes, heavy_rows = max(1, total // RANGES), max(1, count // RANGES)
    piece_bytes, piece_rows = min(heavy_bytes, PIECE_BYTES), min(heavy_rows, PIECE_ROWS)

    # a row of p expected draws is drawn floor(p) times, and once more with the chance of the rest
    expected = F.col("size") * (RANGES * DRAWS / max(total, 1))
    luck = F.pmod(F.xxhash64("id", "key", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    drawn = rows.select("key", F.floor(expected + luck).cast("int").alias("n")).filter("n > 0").select("key", F.explode(F.array_repeat(F.lit(0), F.col("n"))))
    quantiles = drawn.agg(F.percentile_approx("key", [i / RANGES for i in range(1, RANGES)], 20 * RANGES)).first()[0]
    splitters = sorted(set(quantiles or []))  # at most RANGES - 1 numbers

    ranged = rows.withColumn("range", _range_of(F.col("key"), splitters))
    sums = (F.sum("size").alias("bytes"), F.count("*").alias("n"))
    parts = F.greatest(F.ceil(F.col("bytes") / piece_bytes), F.ceil(F.col("n") / piece_rows)).cast("int")
    ranges = ranged.groupBy("range").agg(*sums).select("range", parts.alias("range_parts"))
    heavy = ranged.groupBy("key").agg(*sums).filter((F.col("bytes") > heavy_bytes) | (F.col("n") > heavy_rows)).select("key", "bytes", parts.alias("key_parts")).collect()  # 2 * RANGES at most
    place, room = pinned([(r["key"], r["bytes"]) for r in heavy], total, shards)
    hot = docs.sparkSession.createDataFrame([(r["key"], r["key_parts"], place.get(r["key"])) for r in heavy], "key long, key_parts int, pin int")
    by_id, by_key = (F.pmod(F.xxhash64(c, F.lit(seed)), n) for c, n in (("id", "key_parts"), ("key", "range_parts")))
    placed = (
        ranged.join(F.broadcast(ranges), "range")  # RANGES rows at most
        .join(F.broadcast(hot), "key", "left")
        .select("id", "size", "key", "range", "pin", F.when(F.col("key_parts").isNotNull(), F.col("key")).otherwise(-1).alias("lone"), F.when(F.col("key_parts").isNotNull(), by_id).otherwise(by_key).alias("sub"))
    )
    piece = ["range", "lone", "sub"]
    pieces = placed.groupBy(*piece).agg(*sums, F.max("pin").alias("pin"))
    # Prefix sums over the pieces that no shard has yet, first within ranges, then over the ranges
    loose = F.when(F.col("pin").isNull(), F.col("bytes")).otherwise(0)
    inside = Window.partitionBy("range").orderBy("lone", "sub").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy("range").agg(F.sum(loose).alias("range_bytes")).select("range", F.coalesce(F.sum("range_bytes").over(before), F.lit(0)).alias("range_start"))
    middle = F.col("range_start") + F.coalesce(F.sum(loose).over(inside), F.lit(0)) + F.col("bytes") / 2
    full = list(accumulate(room))[:-1]
    scale = (total - sum(r["bytes"] for r in heavy if r["key"] in place)) / max(sum(room), 1)
    filled = F.size(F.filter(F.array(*(F.lit(x * scale) for x in full)), lambda x: x <= middle)) if full else F.lit(0)
    cut = pieces.join(starts, "range").withColumn("shard", F.coalesce("pin", filled))
    ahead = Window.partitionBy("shard").orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.select(*piece, "shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first_slot"))
    own = Window.partitionBy(*piece).orderBy("id", "key", "size")
    numbered = placed.withColumn("rank", F.row_number().over(own) - 1)
    return numbered.join(cut, piece).select(F.col("id").alias(id_col), "size", "key", "shard", (F.col("first_slot") + F.col("rank")).cast("long").alias("slot"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard(documents(spark, sf_dir), 8)
    return placed.select("doc_id", "size", F.col("key").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
