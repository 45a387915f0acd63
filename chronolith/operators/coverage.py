"""How well a series of moments covers its timeline, in whole units of time.

Every frame of moments has ``series, t`` (bigint, for instance microseconds from the
series' start); ``duration`` is a column or a number in the same unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def spans(moments: DataFrame, duration: Column | int) -> DataFrame:
    """``series, a, b``: stretches between moments, with 0 before the first and the duration behind the last."""
    end = duration if isinstance(duration, Column) else F.lit(duration)
    rows = moments.select("series", "t", end.cast("bigint").alias("end"))
    # a timeline has a fixed number of blocks; what lies outside of it is in the first or the last one
    block = F.floor(F.least(F.greatest(F.col("t"), F.lit(0)), F.col("end")) / F.greatest(F.col("end"), F.lit(1)) * scans.BLOCKS)
    pairs = scans.lagged(rows, block, ["t"], ["t"]).select("series", F.coalesce("before_.t", F.lit(0)).cast("bigint").alias("a"), F.col("t").alias("b"), "end")
    last = pairs.groupBy("series").agg(F.max("b").alias("a"), F.max("end").alias("b"))
    return pairs.select("series", "a", "b").unionByName(last)


def gaps(moments: DataFrame, duration: Column | int, max_gap: int, tolerance: int = 0) -> DataFrame:
    """Stretches that are longer than allowed."""
    return spans(moments, duration).filter(F.col("b") - F.col("a") > max_gap + tolerance)


def summary(moments: DataFrame, duration: int, max_gap: int) -> DataFrame:
    """Of each series its number of moments, longest stretch, uncovered time, coverage in millionths, completeness."""
    length = F.col("b") - F.col("a")
    over = F.sum(F.when(length > max_gap, length).otherwise(0))
    out = spans(moments, duration).groupBy("series").agg((F.count(F.lit(1)) - 1).alias("n_moments"), F.max(length).alias("longest"), over.alias("uncovered"))
    share = F.greatest(F.lit(0), F.lit(duration) - F.col("uncovered")) * 1_000_000
    return out.withColumn("coverage_ppm", F.when(F.lit(duration) > 0, F.expr(f"(greatest(0, {duration} - uncovered) * 1000000) div {max(duration, 1)}")).otherwise(share * 0)).withColumn("complete", F.col("uncovered") == 0)


def gap_stats(moments: DataFrame, duration: int, blind: int) -> DataFrame:
    """Of each series its moments, longest stretch and where it is (of equal ones the latest), and time in stretches over ``blind``."""
    length = F.col("b") - F.col("a")
    worst = F.max(F.struct(length.alias("size"), "a", "b"))
    out = spans(moments, duration).groupBy("series").agg((F.count(F.lit(1)) - 1).alias("n_moments"), F.sum(F.when(length > blind, length).otherwise(0)).alias("blind"), worst.alias("w"))
    return out.select("series", "n_moments", "blind", F.col("w.size").alias("longest"), F.col("w.a").alias("longest_from"), F.col("w.b").alias("longest_to"))


def first_gaps(bare: DataFrame, most: int = 8) -> DataFrame:
    """Of stretches ``series, a, b`` and whatever else the first ``most`` of each series, with ``n`` from 1 on."""
    place = F.row_number().over(Window.partitionBy("series").orderBy("a", "b"))
    return bare.withColumn("n", place).filter(F.col("n") <= most)


def compare(before: DataFrame, after: DataFrame, duration: int, blind: int) -> DataFrame:
    """gap_stats of two selections side by side, for series that either has."""
    named = lambda df, p: gap_stats(df, duration, blind).select("series", *[F.col(c).alias(f"{c}_{p}") for c in ("n_moments", "blind", "longest")])
    return named(before, "before").join(named(after, "after"), "series", "full")


def filled(moments: DataFrame, duration: int, max_gap: int) -> DataFrame:
    """The grid points that close each stretch over ``max_gap``: ``series, t``, evenly set."""
    wide = gaps(moments, duration, max_gap)
    n = F.expr(f"(b - a) div {max_gap}")
    return wide.select("series", "a", "b", n.alias("n"), F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("k")).select("series", F.expr("a + ((b - a) * k) div (n + 1)").alias("t"))


def anchored(moments: DataFrame, min_gap: int) -> DataFrame:
    """Series whose first moment is later than ``min_gap`` get one at 0: rows ``series, t`` to add."""
    return moments.groupBy("series").agg(F.min("t").alias("first")).filter(F.col("first") > min_gap).select("series", F.lit(0).cast("bigint").alias("t"))
