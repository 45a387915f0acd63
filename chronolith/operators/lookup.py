"""Joins of moments with segments, gaps and other moments; all carry ``series`` as key.

Intervals are cut into buckets of time and exploded, so that every join here is an
equality on (series, bucket) with a residual range check, never a nested loop, and a
long series spreads over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def _bucketed(intervals: DataFrame, low: Column, high: Column, width: int) -> DataFrame:
    first, last = F.floor(low / width), F.floor(high / width)
    return intervals.filter(low <= high).withColumn("bucket_", F.explode(F.sequence(first, last)))


def covering(points: DataFrame, intervals: DataFrame, width: int, low: str = "t0", high: str = "t1", slack: int = 0) -> DataFrame:
    """Pairs of a point (``series, t``) and an interval with ``low - slack <= t <= high + slack``.

    ``width`` is the length of a bucket, about that of a usual interval. Other columns of
    the two sides must differ in name.
    """
    cut = _bucketed(intervals, F.col(low) - slack, F.col(high) + slack, width).withColumnRenamed("series", "of_")
    placed = points.withColumn("place_", F.floor(F.col("t") / width))
    return placed.join(cut, (F.col("series") == F.col("of_")) & (F.col("place_") == F.col("bucket_")) & F.col("t").between(F.col(low) - slack, F.col(high) + slack)).drop("of_", "place_", "bucket_")


def segment_at(points: DataFrame, segments: DataFrame, width: int) -> DataFrame:
    """Adds ``segment_i`` to points ``series, id, t``: the first of the segments ``series, i, t0, t1`` that covers it, or null."""
    hit = covering(points.select("series", "id", "t"), segments.select("series", "i", "t0", "t1"), width).groupBy("series", "id").agg(F.min("i").alias("segment_i"))
    return points.join(hit, ["series", "id"], "left")


def in_gap(points: DataFrame, gaps: DataFrame, width: int) -> DataFrame:
    """Adds ``gap_from``, the start of the first gap (``a`` to ``b``, both included) that a point is in, or null."""
    hit = covering(points.select("series", "id", "t"), gaps.select("series", "a", "b"), width, "a", "b").groupBy("series", "id").agg(F.min("a").alias("gap_from"))
    return points.join(hit, ["series", "id"], "left")


def near_texts(points: DataFrame, segments: DataFrame, slack: int, width: int) -> DataFrame:
    """Adds ``near``: the texts of segments within ``slack`` of a point, in order, joined by spaces; empty if none."""
    hit = covering(points.select("series", "id", "t"), segments.select("series", "i", "t0", "t1", "text"), width, slack=slack)
    texts = hit.groupBy("series", "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ").alias("near"))
    return points.join(texts, ["series", "id"], "left").withColumn("near", F.coalesce("near", F.lit("")))


def nearest(probes: DataFrame, moments: DataFrame, k: int, span: int = 1 << 22) -> DataFrame:
    """``series, probe, id, t, distance``: the k moments (``series, id, t``) nearest to each probe (``series, probe, at``), by time.

    Ties go to the earlier time, then to the smaller id, so the k nearest are among the k
    last up to the probe and the k first behind it; only these are compared. Each row
    knows its place among the moments of its series, of equal times once in falling and
    once in rising order of ids, and probes ask for places. Places are counted inside blocks
    of ``span`` of time, and over blocks, so that a long series is spread.
    """
    own = F.struct("t", "id")
    kind = moments.select(own.alias("own")).schema["own"].dataType
    both = moments.select("series", "t", F.lit(0).alias("is_probe"), F.lit(None).cast("bigint").alias("probe"), own.alias("own")).unionByName(
        probes.select("series", F.col("at").alias("t"), F.lit(1).alias("is_probe"), F.col("probe").cast("bigint"), F.lit(None).cast(kind).alias("own"))
    )
    sides = []
    for ids, first, last in ((F.col("own.id").desc(), 1 - k, 0), (F.col("own.id").asc(), 1, k)):
        placed = scans.running(both, scans.block_of(F.col("t"), span), [F.col("t"), F.col("is_probe"), ids], 1 - F.col("is_probe"), "place")
        asked = placed.filter("is_probe = 1").select("series", "probe", F.col("t").alias("at"), F.explode(F.sequence(F.col("place") + first, F.col("place") + last)).alias("place"))
        known = placed.filter("is_probe = 0").select("series", "place", "own.id", F.col("own.t").alias("t"))
        sides.append(asked.join(known, ["series", "place"]))
    pairs = sides[0].unionByName(sides[1]).withColumn("distance", F.abs(F.col("t") - F.col("at")))
    best = F.row_number().over(Window.partitionBy("series", "probe").orderBy("distance", "t", "id"))
    return pairs.withColumn("rank_", best).filter(F.col("rank_") <= k).select("series", "probe", "id", "t", "distance")


def by_ids(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """Frames whose id is asked for, each once however often it is asked."""
    return frames.join(wanted.select("id"), "id", "left_semi")


def not_opened(frames: DataFrame, served: DataFrame) -> DataFrame:
    """Frames that the log of served ones never names."""
    return frames.join(served.select("id"), "id", "left_anti")


def token_totals(frames: DataFrame) -> DataFrame:
    """Of each series the tokens of all frames, those of its last frame (0 without), and eight times these."""
    last = F.max_by("est_tokens", "t")
    return frames.groupBy("series").agg(F.sum("est_tokens").alias("tokens"), F.coalesce(last, F.lit(0)).alias("per_frame")).withColumn("per_call", F.col("per_frame") * 8)
