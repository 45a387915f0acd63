"""Streams in small shuffled batches against the batch operators, restarts included."""

import datetime
import os
import random
import tempfile

import pytest

from chronolith.operators import greedy
from chronolith.sources import store
from chronolith.streaming import folds, served

from .test_store import FIRST, tables

BASE = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
DELAY = 60


@pytest.fixture
def rocks(spark):
    for k, v in folds.STATE_STORE.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    for k in folds.STATE_STORE:
        spark.conf.unset(k)


def shuffled(rows, seed, size):
    """Batches of rows that come at most half the delay out of order, then one that lets time pass."""
    r = random.Random(seed)
    late = sorted(rows, key=lambda x: x[1] + datetime.timedelta(seconds=r.uniform(0, DELAY / 2)))
    return [late[k : k + size] for k in range(0, len(late), size)]


def run(spark, batches, schema, operator, stop_after=None):
    """All rows that the stream gives; with ``stop_after`` it is started again from its checkpoint behind so many batches."""
    folder, out, state = (tempfile.mkdtemp(prefix="spark-live-") for _ in range(3))
    stops = [len(batches)] if stop_after is None else [stop_after, len(batches)]
    done = 0
    for stop in stops:
        for k in range(done, stop):
            spark.createDataFrame(batches[k], schema).coalesce(1).write.parquet(f"{folder}/{k:05d}")
        done = stop
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/*")
        q = operator(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        assert q.awaitTermination(300), "the stream did not end"
    return spark.read.parquet(out).collect()


def at(seconds):
    return BASE + datetime.timedelta(milliseconds=round(seconds * 1000))


@pytest.mark.parametrize("stop_after", [None, 3])
def test_thinned_stream(rocks, stop_after):
    r = random.Random(1)
    rows = []
    for s in ("a", "b", "c"):
        t = 0.0
        for _ in range(60):
            t += r.choice([0.1, 0.4, 0.7, 0.75, 3.0, 9.0])
            rows.append((s, at(t), r.choice([0.1, 0.1, 0.5, r.random()])))
    batches = [*shuffled(rows, 2, 30), [("end", at(9999), 0.0)], [("end", at(10_999), 0.0)]]
    schema = "series string, ts timestamp, change double"
    got = run(rocks, batches, schema, lambda df: folds.thin_close(df, 750, f"{DELAY} seconds"), stop_after)
    base = int(BASE.timestamp() * 1000)
    df = rocks.createDataFrame([(s, int(t.timestamp() * 1000), c) for s, t, c in rows], "series string, t bigint, change double")
    want = sorted((x.series, x.t - base, x.change) for x in greedy.thin_close(df, 750).collect())
    assert sorted((x.series, x.t_ms - base, x.change) for x in got if x.series != "end") == want and len(want) > 60


def test_screens_of_a_stream(rocks):
    r = random.Random(4)
    rows = []
    for s, seen in (("a", [True, True, False]), ("b", [False] * 3)):
        for k in range(50):
            rows.append((s, at(k * 2.0), r.choice(["change", "change", "cue", "grid"]), r.random(), [float(r.choice([0, 0, 1]))] * 2 + [r.choice([0.0, 9.0])], seen))
    schema = "series string, ts timestamp, reason string, change double, pixels array<double>, seen array<boolean>"
    batches = [*shuffled(rows, 5, 17), [("end", at(9999), "grid", 0.0, [0.0] * 3, [True] * 3)], [("end", at(99_999), "grid", 0.0, [0.0] * 3, [True] * 3)]]
    got = run(rocks, batches, schema, lambda df: folds.drop_same_screens(df, 0.5, 0.4, f"{DELAY} seconds", 600_000), 2)
    df = rocks.createDataFrame([(s, int(t.timestamp() * 1000), *x) for s, t, *x in rows], "series string, t bigint, reason string, change double, pixels array<double>, seen array<boolean>")
    want = sorted(tuple(x) for x in greedy.drop_same_screens(df, 0.5, 0.4).collect())
    assert sorted((x.series, x.t_ms, x.reason, x.change, x.replaced) for x in got if x.series != "end") == want
    assert any(w[-1] for w in want)


def test_probes_are_served_once(spark):
    root, folder, checkpoint, out = (tempfile.mkdtemp(prefix="spark-serve-") for _ in range(4))
    store.write_index(root, *tables(spark, *FIRST))
    schema = "series string, probe bigint, at double"
    for k in range(2):
        spark.createDataFrame([("a", k, 0.4), ("b", k, 0.1)], schema).coalesce(1).write.parquet(f"{folder}/{k}")

    def start():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/*")
        assert served.serve(stream, root, "probes", checkpoint, out=out).awaitTermination(120)

    start()
    log = lambda: sorted((x.series, x.id) for x in store.read(spark, root, "served").collect())
    once = log()
    assert len(once) == 4 and spark.read.parquet(out).count() == 4
    for name in ("1", ".1.crc"):
        os.remove(f"{checkpoint}/commits/{name}")  # as if the driver had died behind the second batch's writes
    start()
    assert log() == once and spark.read.parquet(out).count() == 4
