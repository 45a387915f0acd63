"""Bursts of change in a dense signal ``series, i, t, change`` (t bigint)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scans

#: fixed values: change that is active, quiet, and a scene cut; seconds within which bursts are one
ACTIVE, QUIET, SCENE = 0.015, 0.004, 0.3
MERGE_SECONDS = 1.2


def active(signal: DataFrame, threshold: float = ACTIVE) -> DataFrame:
    return signal.filter(F.col("change") >= threshold)


def scene_cuts(signal: DataFrame, threshold: float = SCENE) -> DataFrame:
    """What a plain threshold on the whole picture's change finds, for comparison."""
    return signal.filter(F.col("change_global") >= threshold)


def sessions(signal: DataFrame, threshold: float, merge_gap: int) -> DataFrame:
    """``series, burst, i_from, i_to, t_from, t_to, strength, n``: active samples at most ``merge_gap`` apart; ``i`` goes up with time."""
    block, order = scans.block_of(F.col("i")), ["t", "i"]
    new = (F.col("t") - F.col("before_.t") > merge_gap) | F.col("before_").isNull()
    marked = scans.running(scans.lagged(active(signal, threshold), block, order, ["t"]), block, order, new.cast("bigint"), "burst")
    return marked.groupBy("series", "burst").agg(
        F.min("i").alias("i_from"), F.max("i").alias("i_to"), F.min("t").alias("t_from"), F.max("t").alias("t_to"), F.max("change").alias("strength"), F.count(F.lit(1)).alias("n"),
    )


def settled(signal: DataFrame, bursts: DataFrame, quiet: float, steps: int) -> DataFrame:
    """Adds ``i_settle``: the sample behind the last one that is not quiet, looking ``steps`` samples ahead.

    ``i`` counts a series' samples from 0 without holes. The next quiet sample of each
    sample is found in one backward pass over the series, so that no range join is needed.
    """
    next_calm = scans.least_ahead(signal.select("series", "i", "change"), scans.block_of(F.col("i")), "i", F.when(F.col("change") <= quiet, F.col("i")), "calm")
    calm = next_calm.join(signal.groupBy("series").agg(F.max("i").alias("last")), "series").select("series", F.col("i").alias("i_to"), "calm", "last")
    limit = F.least(F.col("last"), F.col("i_to") + steps)
    stop = F.least(F.coalesce(F.col("calm") - 1, limit), limit)
    return bursts.join(calm, ["series", "i_to"]).withColumn("i_settle", F.least(F.greatest(stop, F.col("i_to")) + 1, F.col("last"))).drop("calm", "last")
