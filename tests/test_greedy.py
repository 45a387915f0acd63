"""Folds against plain loops over random series."""

import random

import pytest

from chronolith.operators import greedy

REASONS = ("grid", "cue", "change")


def series(seed, n):
    r = random.Random(seed)
    t, out = 0, []
    for _ in range(n):
        t += r.choice([1, 5, 200, 700, 800, 3000])
        out.append((t, r.choice([0.0, 0.1, 0.1, 0.5, r.random()])))
    return out


def thin(rows, gap):
    kept = []
    for t, c in rows:
        if kept and t - kept[-1][0] < gap:
            if c > kept[-1][1]:
                kept[-1] = (t, c)
        else:
            kept.append((t, c))
    return kept


def test_thin_close(spark):
    data = {f"s{k}": series(k, 120) for k in range(8)}
    df = spark.createDataFrame([(s, t, c) for s, rows in data.items() for t, c in rows], "series string, t bigint, change double")
    got = {}
    for r in greedy.thin_close(df.repartition(4), 750).orderBy("series", "t").collect():
        got.setdefault(r.series, []).append((r.t, r.change))
    assert got == {s: thin(rows, 750) for s, rows in data.items()}


def split(rows, limit, budget, gap):
    if rows[-1][0] - rows[0][0] <= limit:
        return [rows[-1][0]]
    out, held, last = [], 0.0, None
    for t, c in rows:
        held += c
        if held >= budget and (last is None or t - last >= gap):
            out.append(t)
            last, held = t, 0.0
    if not out or (out[-1] != rows[-1][0] and rows[-1][0] - out[-1] >= gap):
        out.append(rows[-1][0])
    return out


def test_split_bursts(spark):
    r = random.Random(9)
    data = {("a", b): [(b * 10_000_000 + 250 * k, r.random() * 2) for k in range(r.choice([1, 5, 11, 60, 300]))] for b in range(600)}
    df = spark.createDataFrame([(s, b, k, t, c) for (s, b), rows in data.items() for k, (t, c) in enumerate(rows)], "series string, burst bigint, i bigint, t bigint, change double")
    got = {}
    for x in greedy.split_bursts(df, 2500, 5.0, 750).orderBy("t").collect():
        got.setdefault((x.series, x.burst), []).append(x.t)
    assert got == {k: split(rows, 2500, 5.0, 750) for k, rows in data.items()}


def fit(rows, cap, end, gap):
    kept = list(rows)
    while len(kept) > cap:
        best = None
        for i, (t, reason, c) in enumerate(kept):
            if i == 0 and t == 0:
                continue
            new = (kept[i + 1][0] if i + 1 < len(kept) else end) - (kept[i - 1][0] if i else 0)
            worth = REASONS.index(reason)
            cost = (worth, c if worth == 2 else 0.0, new)
            if new <= gap and (best is None or cost < best[0]):
                best = (cost, i)
        if best is None:
            break
        kept.pop(best[1])
    return kept


@pytest.mark.parametrize(("cap", "least"), [(1, 2048), (20, 2048), (60, 2048), (1, 7), (30, 20)])
def test_fit_budget(spark, monkeypatch, cap, least):
    """One block a series, and many that wait for each other."""
    monkeypatch.setattr(greedy, "BUDGET_ROWS", least)
    data = {}
    for k in range(6):
        r = random.Random(k)
        rows = [(t, r.choice(REASONS), c) for t, c in series(k + 50, 90)]
        data[f"s{k}"] = ([(0, "grid", 0.0)] if k % 2 else []) + rows
    ends = {s: rows[-1][0] + 500 for s, rows in data.items()}
    df = spark.createDataFrame([(s, t, x, c, cap, ends[s], 4000) for s, rows in data.items() for t, x, c in rows], "series string, t bigint, reason string, change double, cap int, duration bigint, max_gap bigint")
    got = {}
    for r in greedy.fit_budget(df.repartition(3)).orderBy("series", "t").collect():
        got.setdefault(r.series, []).append((r.t, r.reason, r.change))
    assert got == {s: fit(rows, cap, ends[s], 4000) for s, rows in data.items()}


def test_drop_same_screens(spark):
    rows = []
    r = random.Random(4)
    for k in range(60):
        rows.append(("s", k * 1000, r.choice(["change", "change", "change", "grid"]), 0.1, [float(r.choice([0, 0, 1]))] * 4 + [r.random() * 9] * 2, [True] * 4 + [False] * 2))
    kept, dropped = [rows[0]], 0
    for x in rows[1:]:
        if "grid" not in (x[2], kept[-1][2]) and x[4][:4] == kept[-1][4][:4]:
            kept[-1] = x
            dropped += 1
        else:
            kept.append(x)
    df = spark.createDataFrame(rows, "series string, t bigint, reason string, change double, pixels array<double>, seen array<boolean>")
    got = greedy.drop_same_screens(df.repartition(4), 0.5).orderBy("t").collect()
    assert [x.t for x in got] == [x[1] for x in kept] and sum(x.replaced for x in got) == dropped > 0


def test_same_screens_without_a_task_for_a_series(spark):
    """Many series, masks with nothing set and pixels that are no number; no series is gathered in one frame."""
    import numpy as np

    r = random.Random(12)
    rows = []
    for s in range(6):
        seen = [False] * 4 if s % 3 == 0 else [True, True, False, True]
        for k in range(40):
            rows.append((s, k * 10, r.choice(["change", "cue", "change", "grid"]), r.random(), [r.choice([0.0, 0.0, 1.0, float("nan")]) for _ in range(4)], seen))
    want = []
    for s in range(6):
        kept = []
        for x in (x for x in rows if x[0] == s):
            mask = np.array(x[5]) if any(x[5]) else np.ones(4, bool)
            if kept and "grid" not in (x[2], kept[-1][0][2]) and (np.abs(np.array(x[4]) - np.array(kept[-1][0][4])) > 0.5)[mask].mean() <= 0.34:
                kept[-1] = (x, kept[-1][1] + 1)
            else:
                kept.append((x, 0))
        want += [(x[0], x[1], x[2], x[3], n) for x, n in kept]
    df = spark.createDataFrame(rows, "series bigint, t bigint, reason string, change double, pixels array<double>, seen array<boolean>")
    got = greedy.drop_same_screens(df.repartition(4), 0.5, 0.34)
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(n for *_, n in want)
    assert "InPandas" not in got._jdf.queryExecution().toString()


def test_cue_anchors(spark):
    r = random.Random(6)
    moments = sorted(r.sample(range(100_000), 12))
    cues = sorted(r.sample(range(100_000), 60))
    taken = []
    for t in cues:
        if all(abs(m - t) > 3000 for m in moments + taken):
            taken.append(t)
    m = spark.createDataFrame([("s", t) for t in moments], "series string, t bigint")
    c = spark.createDataFrame([("s", t) for t in cues] + [("other", 5)], "series string, t bigint")
    got = greedy.cue_anchors(c, m, 3000).collect()
    assert sorted(x.t for x in got if x.series == "s") == taken and [x.t for x in got if x.series == "other"] == [5]


@pytest.mark.parametrize("span", [750, 1000, 5000, None])
def test_thin_close_in_blocks(spark, span):
    """Dense and sparse series, ties of time, and blocks that keep nothing."""
    data = {}
    for k in range(6):
        r = random.Random(k)
        t, rows = -3000 if k == 1 else 0, []
        for _ in range(150):
            t += r.choice([0, 1, 40, 90] if k % 2 else [0, 300, 700, 751, 4000])
            rows.append((t, r.choice([0.0, 0.1, 0.5, r.random()])))
        data[f"s{k}"] = rows
    data["falling"] = [(100 * k, 1.0 - k / 1000) for k in range(100)]
    data["rising"] = [(100 * k, k / 1000) for k in range(100)]
    df = spark.createDataFrame([(s, t, c, f"{t}") for s, rows in data.items() for t, c in rows], "series string, t bigint, change double, more string")
    got = {}
    for r in greedy.thin_close(df.repartition(4), 750, span).orderBy("series", "t").collect():
        got.setdefault(r.series, []).append((r.t, r.change))
        assert r.more == f"{r.t}"
    assert got == {s: thin(rows, 750) for s, rows in data.items()}


def test_one_endless_island_is_spread(spark):
    """A million rows of one series, each close to the one before."""
    df = spark.range(1_000_000, numPartitions=8).selectExpr("'s' as series", "id * 100 as t", "cast(pmod(hash(id), 1000) as double) as change")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = greedy.thin_close(df, 750).selectExpr("t", "change", "spark_partition_id() as task").toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = [(r.t, r.change) for r in df.toPandas().itertuples()]
    assert sorted(zip(got["t"], got["change"], strict=True)) == thin(rows, 750)
    assert got["task"].nunique() == 8 and got["task"].value_counts().max() < len(got) / 4


def test_same_screens_over_blocks(spark):
    """Blocks of a series make no difference."""
    r = random.Random(8)
    rows = [("s", k * 10, r.choice(["change", "cue", "grid"]), r.random(), [float(r.choice([0, 0, 0, 1]))] * 3, [True] * 3) for k in range(200)]
    df = spark.createDataFrame(rows, "series string, t bigint, reason string, change double, pixels array<double>, seen array<boolean>").repartition(4)
    whole, cut = (sorted(map(tuple, greedy.drop_same_screens(df, 0.5, 0.1, span).collect())) for span in (1 << 22, 30))
    assert whole == cut and any(x[-1] for x in whole)


@pytest.fixture
def late_broadcast(spark):
    """As with many rows: what is told of the blocks is broadcast when the rows' exchange is done, and several tasks read that."""
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "100KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in confs.items():
        spark.conf.set(k, v)
    yield
    for k in confs:
        spark.conf.unset(k)


def scattered(spark):
    """Rows of a block come from many tasks."""
    ids = spark.range(0, 40_000, 1, 16)
    return ids.selectExpr("id % 50 as series", "id div 50 * 300 as t", "'change' as reason", "cast(pmod(hash(id), 1000) as double) as change").repartition(16)


def by_series(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(tuple(r)[1:])
    return out


def test_blocks_stay_whole_wherever_rows_lie(spark, late_broadcast):
    moments = scattered(spark).select("series", "t", "change")
    got = by_series(greedy.thin_close(moments, 1000, span=120_000).collect())
    assert got == {s: thin(rows, 1000) for s, rows in by_series(moments.collect()).items()}


def test_budget_blocks_stay_whole_wherever_rows_lie(spark, monkeypatch, late_broadcast):
    monkeypatch.setattr(greedy, "BUDGET_ROWS", 400)
    moments = scattered(spark).selectExpr("*", "300 as cap", "240000L as duration", "1500L as max_gap").filter("series < 4")
    got = by_series(greedy.fit_budget(moments).select("series", "t", "reason", "change").collect())
    assert got == {s: fit(rows, 300, 240_000, 1500) for s, rows in by_series(moments.select("series", "t", "reason", "change").collect()).items()}
