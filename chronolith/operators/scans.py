"""Passes over a series in two levels, so that a series of any length is spread.

A series is cut into blocks by a counter or by time. Windows run inside blocks; what
passes from one block to the next (a last row, a sum, a least value) is a small table of a row a
block, scanned by itself and joined back on series and block, which is how the rows lie already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: rows of a counted series that a block has, and blocks of a timeline
BLOCK_ROWS, BLOCKS = 4096, 4096


def block_of(counter: Column, size: Column | int = BLOCK_ROWS) -> Column:
    """The block of a whole number, going up with it."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.floor((counter - F.pmod(counter, size)) / size)


def lagged(rows: DataFrame, block: Column, order: list[str], values: list[str], by: str = "series") -> DataFrame:
    """Adds ``before_``, a struct of ``values`` of the row before in ``order``; null for a series' first. ``block`` goes up with the order."""
    blocks = rows.withColumn("block_", block)
    own = F.lag(F.struct(*values)).over(Window.partitionBy(by, "block_").orderBy(*order))
    ends = blocks.groupBy(by, "block_").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("end_"))
    carried = ends.select(by, "block_", F.lag("end_").over(Window.partitionBy(by).orderBy("block_")).alias("carried_"))
    return blocks.withColumn("before_", own).join(carried, [by, "block_"], "left").withColumn("before_", F.coalesce("before_", "carried_")).drop("block_", "carried_")


def given(rows: DataFrame, told: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """``rows`` with the columns of ``told``, which has one row a key, as an inner join gives them; whole groups of ``keys`` lie sorted in one task.

    That is what a function over partitions needs, and a join with ``repartition`` behind it does not give: Spark drops
    that exchange as the join's own has the same keys, and then may turn the join into a broadcast whose rows stay
    where they were read, or cut a skewed partition. Here both sides pass one exchange, and the told row goes before the group's others.
    """
    whole = " and ".join(f"{k} is not null" for k in keys)
    both = rows.filter(whole).unionByName(told.filter(whole).withColumn("told_", F.lit(True)), allowMissingColumns=True)
    placed = [F.col("told_").asc_nulls_last(), *order]
    group = Window.partitionBy(*keys).orderBy(*placed).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_group = [c for c in told.columns if c not in keys]
    known = both.withColumns({"known_": F.first("told_").over(group)} | {c: F.first(c).over(group) for c in of_group})
    return known.filter("told_ is null and known_").drop("known_").sortWithinPartitions(*keys, *placed)


def running(rows: DataFrame, block: Column, order: list[str], value: Column, name: str, by: str = "series") -> DataFrame:
    """Adds the sum of ``value`` up to each row, this one included."""
    blocks = rows.withColumn("block_", block).withColumn(name, value)
    totals = blocks.groupBy(by, "block_").agg(F.sum(name).alias("total_"))
    carried = totals.select(by, "block_", F.sum("total_").over(Window.partitionBy(by).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)).alias("carried_"))
    own = F.sum(name).over(Window.partitionBy(by, "block_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return blocks.withColumn(name, own).join(carried, [by, "block_"], "left").withColumn(name, F.col(name) + F.coalesce("carried_", F.lit(0))).drop("block_", "carried_")


def least_ahead(rows: DataFrame, block: Column, counter: str, value: Column, name: str, by: str = "series") -> DataFrame:
    """Adds the least ``value`` of all later rows by ``counter``; null where there is none."""
    blocks = rows.withColumn("block_", block).withColumn(name, value)
    leasts = blocks.groupBy(by, "block_").agg(F.min(name).alias("least_"))
    # from the end on, so that frames only grow
    carried = leasts.select(by, "block_", F.min("least_").over(Window.partitionBy(by).orderBy(F.desc("block_")).rowsBetween(Window.unboundedPreceding, -1)).alias("carried_"))
    own = F.min(name).over(Window.partitionBy(by, "block_").orderBy(F.desc(counter)).rowsBetween(Window.unboundedPreceding, -1))
    return blocks.withColumn(name, own).join(carried, [by, "block_"], "left").withColumn(name, F.least(name, "carried_")).drop("block_", "carried_")


def medians(values: DataFrame, by: list[str], value: str, name: str, bins: int = 1024, few: int = 4096) -> DataFrame:
    """Of each group the exact median of ``value`` (a double, not NaN; nulls don't count), in memory bounded by ``bins`` and ``few``.

    The two middle values are sought by rounds: counts by bin between the bounds that are
    known tell which bin holds one, and its least and largest value are the next bounds,
    until a bin has one value or a ``few`` rows, which are sorted.
    """
    v = values.select(*by, F.col(value).cast("double").alias("v_")).filter("v_ is not null")
    whole = v.groupBy(*by).agg(F.count("*").alias("held_"), F.min("v_").alias("low_"), F.max("v_").alias("high_"))
    middle = F.explode(F.array(F.struct(F.lit(0).alias("side_"), F.expr("(held_ - 1) div 2").alias("rank_")), F.struct(F.lit(1).alias("side_"), F.expr("held_ div 2").alias("rank_"))))
    sought = cut(whole.select(*by, "held_", "low_", "high_", middle.alias("m_")).select(*by, "m_.side_", "m_.rank_", "held_", "low_", "high_"))
    wide = (F.col("held_") > few) & (F.col("low_") < F.col("high_"))
    inside = F.col("v_").between(F.col("low_"), F.col("high_"))
    side = [*by, "side_"]
    while not (open_ := sought.filter(wide)).isEmpty():
        half = lambda c: F.col(c) / 2  # so that no difference overflows
        place = F.floor((half("v_") - half("low_")) / (half("high_") - half("low_")) * bins)
        binned = v.join(open_.select(*side, "rank_", "low_", "high_"), by).filter(inside).groupBy(*side, "rank_", place.alias("bin_")).agg(F.count("*").alias("held_"), F.min("v_").alias("low_"), F.max("v_").alias("high_"))
        before = F.sum("held_").over(Window.partitionBy(*side).orderBy("bin_").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held_")
        found = binned.withColumn("before_", before).filter((F.col("before_") <= F.col("rank_")) & (F.col("rank_") < F.col("before_") + F.col("held_")))
        sought = cut(sought.filter(~wide).unionByName(found.select(*side, (F.col("rank_") - F.col("before_")).alias("rank_"), "held_", "low_", "high_")))
    single = sought.filter("low_ = high_").select(*side, F.col("low_").alias("value_"))
    rest = sought.filter("low_ < high_")
    sorted_ = v.join(rest, by).filter(inside).groupBy(*side, "rank_").agg(F.sort_array(F.collect_list("v_")).alias("all_"))
    both = single.unionByName(sorted_.select(*side, F.get("all_", F.col("rank_")).alias("value_")))
    at = lambda k: F.max(F.when(F.col("side_") == k, F.col("value_")))
    return both.groupBy(*by).agg((at(0) * 0.5 + at(1) * 0.5).alias(name))
