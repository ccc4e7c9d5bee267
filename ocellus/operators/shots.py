"""Shots of frame sequences: boundaries, lengths, sampling, as-of joins, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.functions import vec


def boundaries(frames: DataFrame, threshold: float = 0.8, clip: str = "clip", frame: str = "frame", hist: str = "hist") -> DataFrame:
    """clip, frame, similarity: frames that begin a shot, the first of each clip too.

    Similarity is the histogram intersection with the frame before; a shot begins below ``threshold``.
    """
    before = F.lag(hist).over(Window.partitionBy(clip).orderBy(frame))
    like = frames.withColumn("similarity", F.round(vec.distance("kl1", F.col(hist), before), 9))
    return like.filter(F.col("similarity").isNull() | (F.col("similarity") < threshold)).select(clip, frame, "similarity")


def lengths(starts: DataFrame, totals: DataFrame, clip: str = "clip") -> DataFrame:
    """clip, shot (from 0), first, n: from first frames and each clip's number of frames."""
    w = Window.partitionBy(clip).orderBy("first")
    return starts.join(totals, clip).select(clip, (F.row_number().over(w) - 1).alias("shot"), "first", (F.lead("first").over(w)).alias("_next"), "total").select(clip, "shot", "first", (F.coalesce("_next", "total") - F.col("first")).alias("n"))


def sample_positions(n: Column, n_out: Column) -> Column:
    """Frame numbers within a shot of n frames of which n_out are taken (n_out at most n, both positive)."""
    ceil, floor = F.ceil(n / n_out).cast("int"), F.floor(n / n_out).cast("int")
    even = (n % n_out == 0) | ((n_out - 1) * ceil < n)
    step = F.when(even, ceil).otherwise(floor)
    every = F.sequence(F.lit(0), n - 1, step)
    extra = F.size(every) - n_out
    cut = F.slice(every, F.floor(extra / 2).cast("int") + 1, n_out)
    return F.when(n_out == 1, F.array(F.floor(n / 2).cast("int"))).otherwise(F.when(even, every).otherwise(cut))


def sample_frames(shots: DataFrame, n_out: int) -> DataFrame:
    """Columns of shots and frame: the frames sampled from each shot; all for n_out = -1. Empty shots give none."""
    n = F.col("n").cast("int")
    most = n if n_out < 0 else F.least(n, F.lit(n_out))
    return shots.filter("n > 0").withColumn("frame", F.explode(F.transform(sample_positions(n, most), lambda x: x + F.col("first")))).select(*shots.columns, "frame")


def shot_of_frame(frames: DataFrame, starts: DataFrame, clip: str = "clip") -> DataFrame:
    """frames with ``first``: the greatest first frame at most the frame. One sort of both by clip and frame."""
    both = frames.select(clip, "frame", F.lit(None).cast("long").alias("first"), F.lit(1).alias("_f")).unionByName(starts.select(clip, F.col("first").cast("long").alias("frame"), F.col("first").cast("long").alias("first"), F.lit(0).alias("_f")))
    w = Window.partitionBy(clip).orderBy("frame", "_f").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("first", F.last("first", ignorenulls=True).over(w)).filter("_f = 1").select(clip, "frame", "first")


def clip_offsets(totals: DataFrame, clip: str = "clip", buckets: int = 64) -> DataFrame:
    """clip, total, start: frames of all clips before, by ascending clip number.

    Running sums are within ranges between approximate quantiles of the clip numbers, so no task orders
    all clips however they are clustered; the ranges' own sums are added from a table of ``buckets`` rows.
    """
    cuts = totals.agg(F.percentile_approx(clip, [k / buckets for k in range(1, buckets)], 10_000).alias("_q"))
    ranged = totals.join(F.broadcast(cuts)).withColumn("_p", F.size(F.filter("_q", lambda q: q <= F.col(clip)))).drop("_q")
    within = ranged.withColumn("_s", F.sum("total").over(Window.partitionBy("_p").orderBy(clip)) - F.col("total"))
    sums = ranged.groupBy("_p").agg(F.sum("total").alias("_t"))
    before = sums.withColumn("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return within.join(F.broadcast(before), "_p").select(clip, "total", (F.col("_s") + F.col("_b")).alias("start"))
