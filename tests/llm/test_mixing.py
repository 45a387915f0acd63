"""Pareto order sampling: targets, closeness, limits, reruns and odd rows."""

import random

from pyspark.sql import functions as F

from chronolith.llm.mixing import mix, targets


def test_targets_stop_at_their_cap(spark):
    t = targets(spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 5000)], "source string, source_size bigint")).toPandas()
    by = {r.source: r for r in t.itertuples()}
    assert [by[s].weight for s in ("a", "b", "c")] == [3, 1, 2] and by[None].weight == 3
    assert abs(t.target.sum() - 1.5 * t.source_size.sum()) < 1e-6
    assert (t.target <= 2 * t.source_size + 1e-9).all()
    level = by[None].target / 3 if by[None].target < 10_000 else by["b"].target
    for r in t.itertuples():
        assert abs(r.target - min(2 * r.source_size, level * r.weight)) < 1e-6


def test_mix_comes_near_its_targets(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randint(1, 300), r.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    one = mix(df).toPandas()
    two = mix(df.repartition(7)).toPandas()
    assert one.sort_values("doc_id").taken.tolist() == two.sort_values("doc_id").taken.tolist()
    assert (one.taken <= 2 * one["size"]).all() and len(one) == len(rows)
    for _, g in one.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()


def test_preference_shifts_the_odds(spark):
    rows = [(i, "w " * 50, "a" if i % 2 else "b", 4.0 if i % 4 == 1 else 1.0) for i in range(4000)]
    got = mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string, like double"), preference="like").join(spark.createDataFrame(rows, "doc_id bigint, text string, s string, like double"), "doc_id")
    mean = {(r.s, r.like): r.m for r in got.groupBy("s", "like").agg(F.avg("copies").alias("m")).collect()}
    assert mean["a", 4.0] > mean["a", 1.0]


def test_odd_rows(odd, none):
    got = mix(odd).collect()
    assert len(got) == odd.count()
    assert all(r.taken <= 2 * r.size for r in got)
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mix(none).count() == 0
    assert mix(odd.filter("doc_id in (4, 5)")).agg(F.sum("taken")).first()[0] == 0


def test_plan_is_native(odd):
    plan = mix(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
