"""Packing regions into windows of bounded length.

Regions are packed greedily while they fit. A region that is too long is cut at the quietest frame near the ceiling,
again and again, and its rest takes part in the packing. Such a region always ends the window before it, so cutting
doesn't depend on packing: regions are cut on their own first, row by row, and a fold over the file's regions packs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.schemas import CUT_SEARCH_SAMPLES, WINDOW_SAMPLES


def search_from(start: Column, frame_samples: int) -> Column:
    """The first frame at which a window that starts at ``start`` may be cut."""
    return F.floor((start + WINDOW_SAMPLES - CUT_SEARCH_SAMPLES) / frame_samples)


def cut_after(start: Column, probs: Column, from_frame: Column, frame_samples: int) -> Column:
    """Where to cut a window that starts at ``start``: the first of the quietest frames in the last stretch.

    ``probs`` are scores from frame ``from_frame`` on. Null, no frame there, or a cut that doesn't advance: at the ceiling.
    """
    hard = start + WINDOW_SAMPLES
    if not frame_samples:
        return hard
    low = search_from(start, frame_samples)
    high = F.least(F.floor((start + WINDOW_SAMPLES) / frame_samples), from_frame + F.size(probs))
    part = F.slice(probs, (low - from_frame + 1).cast("int"), (high - low).cast("int"))
    quiet = (low + F.array_position(part, F.array_min(part)) - 1) * frame_samples
    return F.when(probs.isNotNull() & (high > low) & (quiet > start), quiet.cast("long")).otherwise(hard)


def sliced(regions: DataFrame, frame_samples: int) -> DataFrame:
    """``regions`` with ``cuts``, the slices of those that are too long, and ``tail``, where the rest starts."""
    start, end, probs = F.col("start_sample"), F.col("end_sample"), F.col("probs")
    most = F.ceil((end - start) / max(1, WINDOW_SAMPLES - CUT_SEARCH_SAMPLES - frame_samples)).cast("int")
    begin = F.struct(start.alias("tail"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("cuts"))

    def step(state: Column, _: Column) -> Column:
        at = cut_after(state["tail"], probs, F.col("from_frame"), frame_samples)
        more = F.struct(at.alias("tail"), F.concat(state["cuts"], F.array(F.struct(state["tail"].alias("start"), at.alias("end")))).alias("cuts"))
        return F.when(end - state["tail"] > WINDOW_SAMPLES, more).otherwise(state)

    done = F.when(end - start > WINDOW_SAMPLES, F.aggregate(F.sequence(F.lit(1), most), begin, step)).otherwise(begin)
    return regions.withColumn("done", done).select("*", F.col("done.tail").alias("tail"), F.col("done.cuts").alias("cuts")).drop("done")


def packed(regions: Column) -> Column:
    """Fold over (start, end, tail) of a file's regions, ascending: the windows, without the slices."""
    empty = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    nothing = F.lit(None).cast("long")
    begin = F.struct(nothing.alias("start"), nothing.alias("end"), empty.alias("out"))

    def step(state: Column, r: Column) -> Column:
        fits = (r["tail"] == r["start"]) & (r["end"] - state["start"] <= WINDOW_SAMPLES)
        flushed = F.concat(state["out"], F.when(state["start"].isNotNull(), F.array(F.struct(state["start"].alias("start"), state["end"].alias("end")))).otherwise(empty))
        return F.when(F.coalesce(fits, F.lit(False)), F.struct(state["start"].alias("start"), r["end"].alias("end"), state["out"].alias("out"))).otherwise(
            F.struct(r["tail"].alias("start"), r["end"].alias("end"), flushed.alias("out"))
        )

    return F.aggregate(regions, begin, step, lambda s: F.when(s["start"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))


def windows(regions: DataFrame, frames: DataFrame | None, frame_samples: int) -> DataFrame:
    """(file_id, window_id, start_sample, end_sample): ascending, disjoint, none longer than the ceiling.

    Scores are gathered only for regions that must be cut, and of each only those from its first search on. They meet
    in bins of a window's length, so that no frame meets all regions of a long file. Without ``frames``, cuts are at the
    ceiling.
    """
    kept = regions.filter("end_sample > start_sample").select("file_id", "start_sample", "end_sample")
    if frames is None or not frame_samples:
        kept = kept.withColumns({"probs": F.lit(None).cast("array<double>"), "from_frame": F.lit(None).cast("long")})
    else:
        bin_of = lambda x: F.floor(x / WINDOW_SAMPLES)
        kept = kept.withColumn("from_frame", search_from(F.col("start_sample"), frame_samples))
        dealt = kept.filter(F.col("end_sample") - F.col("start_sample") > WINDOW_SAMPLES).withColumn("bin", F.explode(F.sequence(bin_of(F.col("from_frame") * frame_samples), bin_of(F.col("end_sample")))))
        scores = frames.select("file_id", "frame", "p", bin_of(F.col("frame") * frame_samples).alias("bin"))
        met = dealt.join(scores, ["file_id", "bin"]).filter((F.col("frame") >= F.col("from_frame")) & (F.col("frame") * frame_samples < F.col("end_sample")))
        listed = met.groupBy("file_id", "start_sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "p"))), lambda x: x["p"]).alias("probs"))
        kept = kept.join(listed, ["file_id", "start_sample"], "left")
    files = sliced(kept, frame_samples).groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("start_sample").alias("start"), F.col("end_sample").alias("end"), "tail"))).alias("rs"), F.flatten(F.collect_list("cuts")).alias("cuts")
    )
    out = files.select("file_id", F.inline(F.concat(packed(F.col("rs")), F.col("cuts"))))
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("start")) - 1
    return out.select("file_id", number.cast("long").alias("window_id"), F.col("start").alias("start_sample"), F.col("end").alias("end_sample"))


def materialised(planned: DataFrame, signals: DataFrame) -> DataFrame:
    """(file_id, window_id, offset, real_len, samples): each window of the signal, padded with silence to full length."""
    n = F.size("samples").cast("long")
    real = F.greatest(F.least(F.col("end_sample"), n) - F.least(F.col("start_sample"), n), F.lit(0).cast("long"))
    cut = F.slice("samples", (F.col("start_sample") + 1).cast("int"), real.cast("int"))
    full = F.concat(cut, F.array_repeat(F.lit(0.0).cast("float"), (F.lit(WINDOW_SAMPLES) - real).cast("int")))
    return planned.join(signals, "file_id").select("file_id", "window_id", F.col("start_sample").alias("offset"), real.alias("real_len"), full.alias("samples"))
