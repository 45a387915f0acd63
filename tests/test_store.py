"""Generations of the store, and search through its index."""

import tempfile

import pytest
from pyspark.sql import functions as F

from chronolith.operators import search
from chronolith.plans import evidence
from chronolith.sources import store


def tables(spark, speech, screens=(), gaps=()):
    """``speech``: series, i, text; ``screens``: series, place, text."""
    seg = spark.createDataFrame([(s, i, float(i), i + 1.0, text, f"0:{i:02d}") for s, i, text in speech], store.SCHEMAS["segments"])
    fr = spark.createDataFrame([(s, k, f"f{k:04d}", k + 0.5, "0:00", f"{s}/{k}.jpg", 64, 36, 10, 6, "grid", None, None, text, None) for s, k, text in screens], store.SCHEMAS["frames"])
    names = sorted({r[0] for r in (*speech, *screens, *gaps)})
    summary = spark.createDataFrame([(s, 99.0, 1, 6, 15.0, 8.0, 1.0, True) for s in names], store.SCHEMAS["summary"])
    return seg, fr, spark.createDataFrame([(s, a, b, "0:00") for s, a, b in gaps], store.SCHEMAS["gaps"]), summary


def state(spark, root):
    out = {}
    for table in ("segments", "frames", "gaps", "summary", "corpus", "served"):
        rows = store.read(spark, root, table).drop("doc", "at")
        out[table] = sorted(map(str, rows.collect()))
    out["hits"] = sorted((h.series, h.ref) for h in evidence.search(spark, root, "words", 100).collect())
    return out


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="spark-store-")


FIRST = [("a", 0, "first words"), ("a", 1, "more"), ("b", 0, "other words")], [("a", 0, "words seen"), ("b", 0, None)], [("a", 1.0, 2.0)]
SECOND = [("a", 0, "second words")], [("a", 0, "new screen")]


def test_series_are_replaced_alone(spark, root):
    assert store.read(spark, root, "frames").isEmpty() and evidence.search(spark, root, "words").isEmpty()
    store.write_index(root, *tables(spark, *FIRST))
    store.log_served(root, store.read(spark, root, "frames"))
    before = store.snapshot(spark, root)
    now = store.write_index(root, *tables(spark, *SECOND))
    assert now.generation == 2 and {r.series: r.text for r in now.table("segments").collect()} == {"a": "second words", "b": "other words"}
    assert now.table("gaps").isEmpty() and [r.series for r in now.table("served").collect()] == ["b"]
    assert [(h.series, h.ref) for h in evidence.search(spark, root, "words").orderBy("series").collect()] == [("a", "seg#0"), ("b", "seg#0")]
    # whoever has read the older generation still sees all of it
    assert before.table("segments").count() == 3 and before.table("gaps").count() == 1
    assert store.snapshot(spark, root, 1).table("corpus").count() == 4
    with pytest.raises(ValueError):
        store.snapshot(spark, root, 7)


def test_a_write_that_stops_anywhere_changes_nothing(spark, root, monkeypatch):
    store.write_index(root, *tables(spark, *FIRST))
    old = state(spark, root)
    put, calls = store._put, []

    for stop in range(6):  # five tables and the postings
        calls.clear()

        def stopping(df, *rest, stop=stop):
            if len(calls) == stop:
                raise OSError("stopped")
            calls.append(rest)
            put(df, *rest)

        monkeypatch.setattr(store, "_put", stopping)
        with pytest.raises(OSError, match="stopped"):
            store.write_index(root, *tables(spark, *SECOND))
        assert len(calls) == stop and state(spark, root) == old
    monkeypatch.setattr(store, "_put", put)
    with open(f"{root}/manifests/000000000002.json", "w") as half:  # a manifest that was cut off
        half.write('{"owners": "x", "wri')
    assert state(spark, root) == old


def test_the_slower_of_two_writes_is_told(spark, root):
    store.write_index(root, *tables(spark, *FIRST))
    base = store.snapshot(spark, root)
    store.write_index(root, *tables(spark, *SECOND))
    seg, _, _, summary = tables(spark, [("b", 0, "late")])
    now = state(spark, root)
    with pytest.raises(store.Conflict):
        store.commit(base, {"segments": seg}, summary)
    assert state(spark, root) == now


def test_texts_and_captions_are_stored(spark, root):
    store.write_index(root, *tables(spark, *FIRST))
    store.log_served(root, store.read(spark, root, "frames"))
    texts = spark.createDataFrame([("a/0.jpg", "  "), ("b/0.jpg", " Read Out "), ("z.jpg", "nobody")], "path string, text string")
    assert store.put_ocr(spark, root, texts) == 1
    assert {r.series: r.ocr for r in store.read(spark, root, "frames").collect()} == {"a": None, "b": "Read Out"}
    assert [h.series for h in evidence.search(spark, root, "read out").collect()] == ["b"]
    assert not evidence.search(spark, root, "words seen").collect() and len(evidence.search(spark, root, "words").collect()) == 2
    assert store.put_caption(spark, root, "b", "f0000", "a cat") and not store.put_caption(spark, root, "b", "f0009", "a dog")
    assert {r.series: (r.ocr, r.caption) for r in store.read(spark, root, "frames").collect()} == {"a": (None, None), "b": ("Read Out", "a cat")}
    assert store.read(spark, root, "served").count() == 2, "texts and captions are no new index"


def test_compacted_and_cleared_stores_hold_the_same(spark, root):
    store.write_index(root, *tables(spark, *FIRST))
    store.write_index(root, *tables(spark, *SECOND))
    store.put_caption(spark, root, "b", "f0000", "a cat")
    old = state(spark, root)
    after = store.compact(spark, root)
    assert after.mixed == [] and all(len(w) == 1 for w in after.writes.values())
    assert state(spark, root) == {**old, "served": []}  # nothing was logged
    assert store.vacuum(spark, root) > 0 and state(spark, root) == old and store.vacuum(spark, root) == 0


def test_a_batch_is_logged_once(spark, root):
    store.write_index(root, *tables(spark, *FIRST))
    ids = spark.createDataFrame([("a", "f0000"), ("b", "f0000")], "series string, id string")
    for _ in range(2):
        evidence.frames(spark, root, ids=ids, batch="q-7")
    assert store.read(spark, root, "served").count() == 2
    evidence.frames(spark, root, ids=ids.limit(1))
    assert store.read(spark, root, "served").count() == 3


QUERIES = ["words", " WORDS ", "ord", "number 7", "ёлк", "not there", "a b", "wordz", "%_", "   x ", "the number 19 and"]


def test_index_finds_what_a_scan_finds(spark, root, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BITS", 3)
    speech = [(f"s{k % 4}", k, f"The number {k} and Words {'Ёлка ' * (k % 3)}x{'a b' if k % 7 == 0 else ''} %_{k}") for k in range(150)]
    store.write_index(root, *tables(spark, speech, [("s9", k, f"screen words {k}") for k in range(20)]))
    store.write_index(root, *tables(spark, [("s1", k, f"replaced {k} ord") for k in range(9)]))
    now = store.snapshot(spark, root)
    assert now.stored("corpus").select("block").distinct().count() > 8 and now.mixed
    for q in QUERIES:
        want = [(h.series, h.ref) for h in search.scan(now.table("corpus"), q, 50).collect()]
        assert [(h.series, h.ref) for h in evidence.search(spark, root, q, 50).collect()] == want, q
    assert len(evidence.search(spark, root, "words", 500).collect()) == len([1 for s, k, _ in speech if s != "s1"]) + 20


def test_only_what_is_needed_is_opened(spark, root, monkeypatch):
    """The plan reads buckets of the query's grams and blocks of candidates; a query that nothing holds opens no text."""
    monkeypatch.setattr(search, "BLOCK_BITS", 3)
    store.write_index(root, *tables(spark, [("s", k, f"plain text of moment {k:03d}" + (" zebra" if k == 77 else "")) for k in range(200)]))
    blocks = store.snapshot(spark, root).stored("corpus").select("block").distinct().count()

    def opened(query):
        found = evidence.search(spark, root, query)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        files = [m for m in _metrics(found) if m[0] == "number of files read"]
        return plan, files

    plan, files = opened("zebra")
    assert any("PartitionFilters" in line and "block#" in line.split("PushedFilters")[0].split("PartitionFilters")[1] for line in plan.splitlines())
    corpus_files = [n for name, n, at in files if "corpus" in at]
    assert blocks > 20 and corpus_files == [1]
    assert [n for _, n, at in opened("zebra unicorn")[1] if "corpus" in at] in ([0], [])


def _metrics(df):
    """(metric, value, place) of the scans that ran."""
    out = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec":
            metric = node.metrics().get("numFiles")
            out.append(("number of files read", metric.get().value(), node.relation().location().rootPaths().mkString(",")))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_lists_are_differences(spark):
    body = spark.createDataFrame([("s", "speech", 0.0, f"r{k}", "abc" if k % 5 == 0 else "xyz", k, k, k >> 4) for k in range(64)], "series string, kind string, t double, ref string, body string, place bigint, doc bigint, block bigint")
    rows = {(r.gram, r.block): r for r in search.packed_postings(body).collect()}
    assert len(rows) == 8 and rows["abc", 1].first == 20 and rows["abc", 1].gaps == [0, 5, 5] and rows["abc", 1].n == 3
    assert {r.bucket for r in rows.values()} == {b[0] for b in spark.createDataFrame([("abc",), ("xyz",)], "g string").select(search.bucket_of(F.col("g"))).collect()}


def test_rows_of_one_series_are_cut(spark, tmp_path):
    """Frames of one series are not all written by one task."""
    rows = [("s", k, f"f{k:04d}", float(k)) for k in range(400)]
    missing = [c for c in store.SCHEMAS["frames"].split(", ") if c.split()[0] not in ("series", "place", "id", "t")]
    frames = spark.createDataFrame(rows, "series string, place bigint, id string, t double").select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in missing])
    series = frames.select("series").distinct()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.commit(store.snapshot(spark, str(tmp_path)), {"frames": frames}, series)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    now = store.read(spark, str(tmp_path), "frames")
    assert now.count() == 400 and len(now.inputFiles()) > 4
