"""Samples and filters."""

import numpy as np
from pyspark.sql import functions as F

from chronolith.llm import storage


def test_a_sample_is_the_smallest_hashes(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("text"))
    keys = storage.sample_keys(docs, (F.col("doc_id") % 3 == 0).alias("g")).filter("not g or doc_id < 60")
    got = storage.sample_rows(docs, keys.union(keys), "g", 200, 10**6)
    by = {g: [r["doc_id"] for r in got if r["g"] == g] for g in (True, False)}
    ranked = [r.doc_id for r in docs.filter("doc_id % 3 <> 0").orderBy(F.xxhash64("doc_id")).limit(200).collect()]
    assert by[False] == ranked and sorted(by[True]) == list(range(0, 60, 3))
    assert storage.sample_rows(docs, keys.limit(0), "g", 5, 50) == []


def test_a_sample_is_bounded(spark):
    """One id on many rows gives one row; bytes end a sample; a text longer than all of it is passed over."""
    docs = spark.range(5000).select(F.lit(7).cast("bigint").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    docs = docs.union(docs).union(spark.range(10, 30).select("id", F.repeat(F.lit("y"), 100))).union(spark.createDataFrame([(99, "z" * 5000)], docs.schema))
    keys = storage.sample_keys(docs, F.lit(1).alias("g"))
    assert len(storage.sample_rows(docs, keys, "g", 10, 10**6)) == 10
    got = storage.sample_rows(docs, keys, "g", 1000, 3000)
    assert len(got) == len({r["doc_id"] for r in got}) == 21 and 99 not in {r["doc_id"] for r in got}
    assert sum(len(r["text"]) for r in storage.sample_rows(docs, keys, "g", 1000, 450)) <= 450


def test_filters_let_their_own_pass(spark):
    named = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = storage.hash_filter(named, "h")
    inside = named.toPandas().h.to_numpy()
    assert storage.passes(bits, inside).all()
    other = spark.range(10**6, 10**6 + 5000).select(F.xxhash64("id").alias("h")).toPandas().h.to_numpy()
    assert storage.passes(bits, other).mean() < 0.01
    assert not storage.passes(np.zeros_like(bits), inside).any()


def test_split_by_keeps_every_row(spark):
    docs = spark.range(1000).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id"))
    docs = docs.withColumn("key", F.lit("mine"))
    clear, maybe, key = storage.split_by(docs, F.col("doc_id"), spark.range(10, 60).select("id"))
    assert clear.count() + maybe.count() == 1000 and clear.columns == ["doc_id", "key"] and key == "key_"
    assert {r[key] for r in maybe.collect()} >= set(range(10, 60)) and clear.filter("doc_id is null").count() == 1
    assert maybe.union(clear.withColumn("key_", F.lit(None))).filter("key = 'mine'").count() == 1000


def test_small_batches(spark):
    """A session's larger bound becomes 4 MB; a smaller one of its own stays."""
    query = storage.small_batches(lambda spark, n: spark.range(n))
    before = spark.conf.get(storage.BATCH_SETTING)
    try:
        for own, then in (("64m", 4 << 20), ("1m", 1 << 20)):
            spark.conf.set(storage.BATCH_SETTING, own)
            assert query(spark, 3).count() == 3
            assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(storage.BATCH_SETTING)) == then
    finally:
        spark.conf.set(storage.BATCH_SETTING, before)
