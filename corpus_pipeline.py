"""From raw documents to a training mix, stage by stage.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of their
``docs``; columns beyond ``doc_id, text, lang, source, n_chars`` pass through unused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import secret_crf
from chronolith.llm.jaccard_groups import jaccard_components
from chronolith.llm.langid import clear_only, dictionaries
from chronolith.llm.mixing import mix
from chronolith.llm.storage import saved, small_batches, split_by
from chronolith.llm.winnowing import contamination

#: what stands in the place of a secret
REDACTED = "[secret]"


@small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; null texts and narrow margins go."""
    return clear_only(docs, dictionaries(docs))


@small_batches
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; of repeated ids the least row as JSON, whatever their texts.

    Documents without words, or without an id, are linked with nothing and stay.
    """
    groups = saved(jaccard_components(docs), "pipeline-groups")
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    again = groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    kept, others, key = split_by(docs, F.col("doc_id"), saved(gone.union(again), "pipeline-named"))
    others = others.drop(key).join(gone, "doc_id", "left_anti")
    row = F.struct(*docs.columns)  # maps have no order, so rows are compared as JSON
    once = others.groupBy("doc_id").agg(F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias("row")).select("row.*")
    return kept.unionByName(once)


@small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item; of rows with one id each is judged by its own text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    told = contamination(docs.select(own.alias("doc_id"), "text"), benchmark)
    gone = saved(told.filter("contaminated").select("doc_id").distinct(), "pipeline-leaks")
    kept, others, key = split_by(docs, own, gone)
    return kept.unionByName(others.join(gone.withColumnRenamed("doc_id", key), key, "left_anti").drop(key))


@small_batches
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with a mark in place of each secret; ``n_chars`` follows the text."""
    found = secret_crf.redact(docs, secret_crf.fit(secret_crf.training_sample(docs)), REDACTED)
    if "n_chars" not in docs.columns:
        return found
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@small_batches
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: ``doc_id, source, size, copies, taken, target`` of the documents that are taken at least once."""
    return mix(docs).filter("copies > 0").select("doc_id", "source", "size", "copies", "taken", "target")


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: compression and the random field can't be told in SQL
ORACLE_SQL = None
