"""The pipeline: each stage against plain versions of its decision, and odd rows."""

import corpus_pipeline as cp
from pyspark.sql import functions as F

from chronolith.llm import secret_crf
from chronolith.llm.winnowing import contamination

from ..conftest import SF
from .conftest import prose
from .test_jaccard import brute


def test_stages_over_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = cp.saved(stage(spark, docs, SF), f"test-{name}")
        rows[name] = docs.count()
        if name != "source_mix":
            assert docs.columns == columns
        if name == "language_id":
            assert rows[name] > 0.9 * before.count()
        if name == "jaccard_join":
            low, _ = brute([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in docs.collect()} == set(low.values())
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            leaks = {r.doc_id for r in contamination(before, bench).filter("contaminated").collect()}
            assert leaks and {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - leaks
        if name == "secret_scan":
            assert rows[name] == before.count()
            assert not any(secret_crf.base_matches(r.text or "") for r in docs.collect())
            changed = docs.select("doc_id", F.col("text").alias("new"), "n_chars").join(before.select("doc_id", "text"), "doc_id").filter("new <> text")
            assert changed.count() and changed.filter("length(new) <> n_chars or not contains(new, '[secret]')").count() == 0
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))
    assert docs.filter("copies not in (1, 2)").count() == 0


def test_odd_rows(spark, odd, none):
    for name, stage in cp.STAGES:
        got = stage(spark, odd, SF)
        if name != "source_mix":
            assert got.columns == odd.columns, name
        assert got.count() <= odd.count()
        assert stage(spark, none, SF).count() == 0, name
    kept = cp.jaccard_join(spark, odd, SF)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 5, 6, 7, 8, 9, 10, 11]
    assert kept.filter("doc_id is null").count() == 2
    assert cp.secret_scan(spark, odd, SF).count() == odd.count()


def test_rows_without_ids_are_judged_too(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(None, prose(1, 40) + " " + item, "en", "a", 1), (None, prose(1, 40), "en", "a", 1), (5, item, "en", "a", 1), (5, prose(2, 40), "en", "a", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = cp.decontamination(spark, docs, SF).collect()
    assert sorted(r.text for r in got) == sorted([prose(1, 40), prose(2, 40)])


def test_other_columns_survive(spark):
    """A column named like a key, and one of a type without order, beside repeated ids."""
    rows = [(1, prose(1, 40), "en", "a", 1, "mine", {"a": 1}), (1, prose(2, 40), "en", "a", 1, "mine", {"a": 2}), (2, prose(1, 40), "en", "a", 1, "mine", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, m map<string,int>")
    for stage in (cp.jaccard_join, cp.decontamination, cp.secret_scan):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and {r.key for r in got.collect()} == {"mine"}
    assert cp.jaccard_join(spark, docs, SF).count() == 1
