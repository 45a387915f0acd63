"""Selection invariants, audit rules, search, the store, and live coverage."""

import datetime
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from chronolith.operators import audit, lookup, search
from chronolith.plans import selection
from chronolith.sources import store
from chronolith.streaming import guard


def dense(spark, seconds, events, magnitude=0.3, screens=None, noisy=0.0):
    """A signal of 4 samples a second that changes at given seconds."""
    r = random.Random(0)
    rows = []
    for i in range(int(seconds * 4)):
        t = i * 250
        hit = any(abs(t - e * 1000) < 1 for e in events)
        screen = float(screens(t / 1000)) if screens else float(i % 251)
        rows.append(("s", i, t, (magnitude if hit else 0.0) + noisy * r.random(), magnitude / 9 if hit else 0.0, [screen], [True]))
    signal = spark.createDataFrame(rows, "series string, i bigint, t bigint, change double, change_global double, pixels array<double>, seen array<boolean>")
    return signal, spark.createDataFrame([("s", int(seconds * 1000))], "series string, duration bigint")


def picked(spark, *args, cap=0, max_gap=15.0, cues=None, keyframes=False, **more):
    signal, durations = dense(spark, *args, **more)
    got = selection.select_moments(signal, durations, 24.0, cap=cap, max_gap=max_gap, cues=cues, keyframes=keyframes)
    return got.orderBy("t").collect(), selection.report(got, durations, max_gap).first()


def test_quiet_series_is_covered_by_grid_points(spark):
    rows, told = picked(spark, 300, [])
    assert {r.reason for r in rows} == {"grid"} and rows[0].t == 0
    assert told.complete and told.coverage_ppm == 1_000_000 and told.longest <= 15_000


def test_events_are_caught_and_gaps_closed(spark):
    events = [10, 25, 40, 55, 70]
    rows, told = picked(spark, 90, events)
    for e in events:
        assert any(r.reason == "change" and abs(r.t - e * 1000) <= 2000 for r in rows)
    assert told.longest <= 15_000 and told.n_moments == len(rows)


@pytest.mark.parametrize("seconds", [60, 600])
def test_longest_stretch(spark, seconds):
    _, told = picked(spark, seconds, [seconds // 3], max_gap=20.0, cap=500)
    assert told.longest <= 20_000


def test_budget_never_breaks_coverage(spark):
    rows, told = picked(spark, 600, list(range(5, 600, 7)), cap=45)
    assert told.longest <= 15_000 and len(rows) <= 60
    rows, told = picked(spark, 600, [], max_gap=5.0, cap=10)
    assert told.complete and len(rows) > 10


def test_equal_screens_keep_the_last(spark):
    rows, _ = picked(spark, 60, [10, 12, 14], screens=lambda s: 7)
    assert [r.t >= 14_000 for r in rows if r.reason == "change"] == [True]


def test_cues_and_key_frames(spark):
    cues = spark.createDataFrame([("s", 33_000), ("s", 34_000), ("s", 999_000)], "series string, t bigint")
    rows, _ = picked(spark, 60, [10], cues=cues)
    assert [r.t for r in rows if r.reason == "cue"] == [33_000]
    rows, told = picked(spark, 30, [], keyframes=True, screens=lambda s: int(s // 5) * 50)
    assert sum(r.reason == "change" for r in rows) >= 5 and told.complete


def test_short_series(spark):
    rows, told = picked(spark, 14, [7])
    assert len(rows) >= 4 and told.longest < 15_000


def evidence(spark, text):
    return audit.audit(
        spark.createDataFrame([("s", 1, text)], "series string, doc_id bigint, text string"),
        spark.createDataFrame([("s", 0, "f0001", 60.0, "terminal output shown here", "p1"), ("s", 1, "f0002", 120.0, "other screen text", "p2"), ("s", 2, "f0003", 480.0, None, "p3")], "series string, place bigint, id string, t double, ocr string, path string"),
        spark.createDataFrame([("s", 0, 55.0, 70.0, "we install the package now"), ("s", 1, 115.0, 130.0, "and here it runs"), ("s", 2, 470.0, 490.0, "the last words said")], "series string, i bigint, t0 double, t1 double, text string"),
        spark.createDataFrame([("s", 300.0, 340.0)], "series string, a double, b double"),
        spark.createDataFrame([("s", "f0001"), ("s", "f0003")], "series string, id string"),
    )


@pytest.mark.parametrize(
    ("line", "codes"),
    [
        ("Shown [1:00 / f0001]", []), ("Shown [1:00 / f0999]", ["FRAME_NOT_FOUND"]), ("Shown [1:30 / f0001]", ["TIME_MISMATCH"]), ("Said [5:20]", ["IN_COVERAGE_GAP"]), ("Shown [2:00 / f0002]", ["NEVER_OPENED"]),
        ("It says \"wholly invented wording\" [1:00 / f0001]", ["QUOTE_NOT_ON_SCREEN"]), ("«install the package» [1:00 / f0001]", []), ("`Terminal,  OUTPUT shown` [1:00 / f0001]", []),
        ("\"never said at all\" [8:00 / f0003]", ["QUOTE_NOT_IN_SPEECH"]), ("\"nothing to compare with\" [9:50]", []),
    ],
)
def test_findings(spark, line, codes):
    (r,) = evidence(spark, line).collect()
    assert [f.code for f in r.findings] == codes
    assert r.severity == ("OK" if not codes else "FAIL" if codes[0] in ("FRAME_NOT_FOUND", "TIME_MISMATCH", "IN_COVERAGE_GAP") else "WARN")


def test_claims_of_wrapped_lines(spark):
    text = "# Head\n\n- first claim that\n  goes on [1:00 / f0001] and [2:00]\n- second [2:00 / f0002]\n\nlast\nline [0:05]"
    rows = evidence(spark, text).orderBy("n").collect()
    assert [(r.n, r.line_no, r.t, r.frame_id) for r in rows] == [(1, 3, 60.0, "f0001"), (2, 3, 120.0, None), (3, 5, 120.0, "f0002"), (4, 7, 5.0, None)]
    assert rows[0].text == "first claim that goes on  and" and rows[3].text == "last line"
    tasks = audit.second_look(evidence(spark, text)).collect()
    assert sorted((t.claim_id, t.frame_path) for t in tasks) == [(1, "p1"), (3, "p2")]
    assert audit.totals(evidence(spark, text)).first()[2:] == (4, 0, 1, 2)
    assert evidence(spark, "no tags").count() == 0


def test_texts_are_taken_apart_once(spark):
    """Gaps and speech are asked of claims that are there already: no plan of the audit goes back to the texts."""
    judged = evidence(spark, "- first [1:00 / f0001]\n- second [2:00 / f0002]")
    assert "posexplode" not in judged._jdf.queryExecution().optimizedPlan().toString()
    assert judged.count() == 2


def test_search_paths(spark):
    seg = spark.createDataFrame([("s", i, float(10 - i), f"Speech {i} AI ёлка" if i % 2 else "other") for i in range(6)], "series string, i bigint, t0 double, text string")
    frames = spark.createDataFrame([("s", 0, "f0000", 1.0, "ai on screen, Ёлка"), ("s", 1, "f0001", 2.0, ""), ("s", 2, "f0002", 3.0, None)], "series string, place bigint, id string, t double, ocr string")
    body = search.corpus(seg, frames)
    assert body.count() == 7
    assert [h.ref for h in search.search(body, " AI ", 3).collect()] == ["seg#5", "seg#3", "seg#1"]
    assert [h.ref for h in search.search(body, "ёлка", 20).collect()] == ["f0000", "seg#5", "seg#3", "seg#1"]
    assert search.search(body, "елка").count() == 0 and search.search(body, "ел", 20).count() == 4
    assert search.search(body, "").count() == 7
    index = search.postings(body)
    assert [h.ref for h in search.search_postings(index, body, "ЁЛКА").collect()] == ["f0000", "seg#5", "seg#3", "seg#1"]


def test_nearest_ties_go_to_the_earlier(spark):
    r = random.Random(3)
    frames = [("s", k, t) for k, t in enumerate(sorted(r.choices(range(60), k=40)))]
    probes = [("s", k, t) for k, t in enumerate(range(-3, 70, 2))]
    got = {}
    for x in lookup.nearest(spark.createDataFrame(probes, "series string, probe bigint, at bigint"), spark.createDataFrame(frames, "series string, id bigint, t bigint"), 4).orderBy("probe", "t", "id").collect():
        got.setdefault(x.probe, []).append(x.id)
    for _, k, at in probes:
        assert got[k] == sorted(i for _, i, t in sorted(frames, key=lambda f: (abs(f[2] - at), f[2], f[1]))[:4])


def test_texts_by_path(spark):
    frames = spark.createDataFrame([(s, 0, "f0000", 1.0, "0:01", f"{s}.jpg", 64, 36, 10, 6, "grid", 0, None, None, None) for s in "ab"], store.SCHEMAS["frames"])
    texts = spark.createDataFrame([("a.jpg", " seen "), ("b.jpg", " ")], "path string, text string")
    with_text = store.with_ocr(frames, texts)
    assert {r.series: r.ocr for r in with_text.collect()} == {"a": "seen", "b": None}
    assert {r.series: r.caption for r in store.with_caption(with_text, "a", "f0000", "a cat").collect()} == {"a": "a cat", "b": None}
    folder = tempfile.mkdtemp(prefix="spark-lines-")
    frames.select("series", "id").write.json(f"{folder}/lines")
    assert store.read_jsonl(spark, f"{folder}/lines", "frames").filter("ocr is null").count() == 2


def test_nothing_old_stays_in_the_store(spark):
    """A series that is indexed again without gaps, speech or frames has none; the other one keeps its own."""
    root = tempfile.mkdtemp(prefix="spark-store-")
    empty = lambda name: spark.createDataFrame([], store.SCHEMAS[name])
    gaps = spark.createDataFrame([("007", 1.0, 9.0, "0:01"), ("t", 2.0, 9.0, "0:02")], store.SCHEMAS["gaps"])
    speech = spark.createDataFrame([("007", 0, 0.0, 5.0, "old words", "0:00"), ("t", 0, 0.0, 5.0, "kept words", "0:00")], store.SCHEMAS["segments"])
    summary = spark.createDataFrame([(s, 9.0, 0, 0, 15.0, 8.0, 1.0, True) for s in ("007", "t")], store.SCHEMAS["summary"])
    store.write_index(root, speech, empty("frames"), gaps, summary)
    from chronolith.plans import evidence as plan

    assert [h.series for h in plan.search(spark, root, "old words").collect()] == ["007"]
    store.write_index(root, empty("segments"), empty("frames"), empty("gaps"), summary.filter("series = '007'"))
    for table, left in (("segments", ["t"]), ("gaps", ["t"]), ("corpus", ["t"]), ("summary", ["007", "t"])):
        assert sorted(r.series for r in store.read(spark, root, table).collect()) == left
    assert plan.search(spark, root, "old words").isEmpty()


def test_live_guard(spark):
    folder, out, state = (tempfile.mkdtemp(prefix="spark-live-") for _ in range(3))
    at = lambda s: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s)
    schema = "series string, ts timestamp, change double"
    for k, batch in enumerate([[("a", at(0), 1.0), ("a", at(10), 1.0), ("b", at(0), 1.0)], [("a", at(55), 1.0)], [("c", at(300), 1.0)], [("c", at(301), 1.0)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(f"{folder}/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.json").json(f"{folder}/*")
    q = guard.guard(stream.select("series", "ts"), 20_000, "5 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    base = int(at(0).timestamp() * 1000)
    a = sorted((r.t_ms - base, r.reason) for r in rows if r.series == "a" and r.t_ms - base <= 55_000)
    assert a == [(0, "moment"), (10_000, "moment"), (25_000, "grid"), (40_000, "grid"), (55_000, "moment")]
    assert any(r.reason == "grid" and r.t_ms - base == 75_000 for r in rows if r.series == "a")
    assert any(r.reason == "grid" and r.t_ms - base == 20_000 for r in rows if r.series == "b")


def test_live_sessions_match_batch(spark):
    rows = [("a", datetime.datetime(2024, 1, 1, 0, 0, s), c) for s, c in ((0, 1.0), (1, 2.0), (2, 0.0), (9, 1.5))]
    got = guard.sessions(spark.createDataFrame(rows, "series string, ts timestamp, change double"), 0.5, "3 seconds", "1 minute").orderBy("ts_from").collect()
    assert [(r.n, r.strength) for r in got] == [(2, 2.0), (1, 1.5)]


def test_the_whole_way(spark):
    from chronolith.plans import evidence as e

    root = tempfile.mkdtemp(prefix="spark-way-")
    signal, _ = dense(spark, 90, [10, 25, 40, 55, 70])
    spoken = spark.createDataFrame([("s", 0, 9_000, 12_000, "right here we type"), ("s", 1, 50_000, 61_000, "the end of it")], "series string, i bigint, t0_ms bigint, t1_ms bigint, text string")
    about = spark.createDataFrame([("s", 90.0, 1920, 1080, "https://youtu.be/x")], "series string, duration double, width int, height int, url string")
    e.index(root, signal, spoken, about, 24.0)
    rows = store.read(spark, root, "frames").orderBy("place").collect()
    assert [r.id for r in rows] == [f"f{k:04d}" for k in range(len(rows))] and rows[0].t == 0.0
    assert {(r.w, r.h, r.est_tokens) for r in rows} == {(1280, 720, 1196)} and rows[1].url.startswith("https://youtu.be/x?t=")
    assert {r.segment_i for r in rows if 9 <= r.t <= 12} == {0} and {r.segment_i for r in rows if r.t < 9} == {None}
    told = e.report(spark, root).first()
    assert told.complete and told.n_frames == len(rows) == told.n_grid + told.n_cue + told.n_change and told.tokens_call == 1196 * 8
    assert [h.ref for h in e.search(spark, root, "Right Here").collect()] == ["seg#0"]
    near = e.frames(spark, root, spark.createDataFrame([("s", 7, 10.2)], "series string, probe bigint, at double"), count=2).orderBy("t").collect()
    assert len(near) == 2 and not near[0].in_gap and min(abs(r.t - 10.2) for r in near) == min(abs(r.t - 10.2) for r in rows)
    seen = next(r for r in rows if r.id == near[0].id)
    clock = f"{int(seen.t // 60)}:{int(seen.t % 60):02d}"
    claims = e.verify(spark, root, spark.createDataFrame([("s", 1, f"- typed [{clock} / {seen.id}]\n- nowhere [0:30 / f9999]")], "series string, doc_id bigint, text string")).orderBy("n").collect()
    assert [c.severity for c in claims] == ["OK", "FAIL"]
    assert e.frames(spark, root, ids=spark.createDataFrame([("s", "f0001"), ("s", "f0001")], "series string, id string")).count() == 1
