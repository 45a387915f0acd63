"""Two-level passes and distributed medians against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import scans


def rows_of(seed, n):
    r = random.Random(seed)
    out = []
    for s in ("hot", "b", "c"):
        for k in sorted(r.sample(range(10 * n), n if s == "hot" else 3)):
            out.append((s, k, r.choice([None, 0, 1, 5, 9])))
    return out


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_passes_over_blocks(spark, size):
    rows = rows_of(size, 200)
    df = spark.createDataFrame(rows, "series string, i bigint, x bigint").repartition(5)
    block = scans.block_of(F.col("i"), size)
    lag = {(r.series, r.i): r.before_ for r in scans.lagged(df, block, ["i"], ["i", "x"]).collect()}
    run = {(r.series, r.i): r.total for r in scans.running(df, block, ["i"], F.coalesce("x", F.lit(0)), "total").collect()}
    least = {(r.series, r.i): r.least for r in scans.least_ahead(df, block, "i", F.col("x"), "least").collect()}
    for s in ("hot", "b", "c"):
        own = [r for r in rows if r[0] == s]
        total = 0
        for k, (_, i, x) in enumerate(own):
            total += x or 0
            later = [y for _, _, y in own[k + 1 :] if y is not None]
            assert run[s, i] == total and least[s, i] == (min(later) if later else None)
            assert (lag[s, i] is None) == (k == 0) and (k == 0 or tuple(lag[s, i]) == own[k - 1][1:])


def test_blocks_go_up(spark):
    got = spark.createDataFrame([(k,) for k in (-9, -8, -1, 0, 1, 7, 8)], "k bigint").select(scans.block_of(F.col("k"), 8)).collect()
    assert [r[0] for r in got] == [-2, -1, -1, 0, 0, 0, 1]


def test_a_hot_series_is_spread(spark):
    """No task of the two passes gets more than a few blocks of the one long series."""
    df = spark.range(50_000).selectExpr("'hot' as series", "id as i", "id % 7 as x")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scans.running(df, scans.block_of(F.col("i"), 500), ["i"], F.col("x"), "total").withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in got.groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 50_000 and len(sizes) >= 6 and max(sizes) < 20_000


@pytest.mark.parametrize("few", [1, 100_000])
def test_medians_are_exact(spark, few):
    r = random.Random(few)
    groups = {
        "uniform": [r.random() for _ in range(501)], "even": [r.random() for _ in range(400)], "same": [2.5] * 300, "one": [7.0], "two": [1.0, 2.0], "wide": [10.0 ** r.randint(-9, 9) * r.choice([-1, 1]) for _ in range(99)] + [1.7e308, -1.7e308],
        "steps": [r.choice([0.0, 0.25, 1.0]) for _ in range(999)], "nulls": [None, None, 4.0, None],
    }
    df = spark.createDataFrame([(g, k % 2, v) for g, vs in groups.items() for k, v in enumerate(vs)] + [("empty", 0, None)], "g string, cell int, v double").repartition(4)
    got = {(x.g, x.cell): x.m for x in scans.medians(df, ["g", "cell"], "v", "m", bins=256, few=few).collect()}
    want = {}
    for g, vs in groups.items():
        for cell in (0, 1):
            own = [v for k, v in enumerate(vs) if k % 2 == cell and v is not None]
            if own:
                want[g, cell] = float(np.sort(own)[(len(own) - 1) // 2] * 0.5 + np.sort(own)[len(own) // 2] * 0.5)
    assert got == want
    assert got == {(x.g, x.cell): x.m for x in df.groupBy("g", "cell").agg(F.median("v").alias("m")).filter("m is not null").collect()}
