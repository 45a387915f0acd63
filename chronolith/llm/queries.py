"""Queries of the operators over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbt_rules, secret_crf, sql, suffix_tree
from .filter_audit import audit as filter_audit
from .forced_bpe import round_trip
from .jaccard_groups import jaccard_components
from .langid import dictionaries, identify
from .mixing import mix
from .perspectives import rotate
from .quality_crf import fit as fit_crf
from .quality_crf import quality, training_sample
from .storage import crc_rest, small_batches
from .structure_repair import summary as repair_summary
from .token_counts import edited_counts, review_edits
from .winnowing import contamination


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_rest(F.col("doc_id"), 3) == 1
    sample = training_sample(docs.filter(~held_out), table(spark, sf_dir, "labels"))
    scored = quality(docs, fit_crf(*sample))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_rest(F.col("doc_id"), 4) == 2
    found = identify(docs.select("doc_id", "text"), dictionaries(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = edited_counts(docs.select("doc_id", "text", review_edits(F.col("text"), F.col("doc_id")).alias("edits")))
    return counted.withColumn("text_sha256", F.sha2("text_after", 256)).drop("text_after")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_crf.scan(docs, secret_crf.fit(secret_crf.training_sample(docs)))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = gbt_rules.fit(*training_sample(docs, table(spark, sf_dir, "labels")))
    return gbt_rules.apply_rules(docs, forest)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = rotate(table(spark, sf_dir, "conversations"))
    return turns.select("conv_id", "perspective", "turn", "speaker", F.sha2("rendered", 256).alias("rendered_sha256"), "start", "mask_start", "mask_end", "trained")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_rest(F.col("doc_id"), 7) == 2
    tree = suffix_tree.fit(docs.filter(~held_out))
    return suffix_tree.score(docs, tree).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(tree.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_summary(table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_language_id": op2_language_id,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_mix_sources": op4_mix_sources,
    "op5_token_counts": op5_token_counts,
    "op6_secret_scans": op6_secret_scans,
    "op7_quality_rules": op7_quality_rules,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_structure_repair": op11_structure_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_bpe_round_trip": op13_bpe_round_trip,
}
QUERIES = {name: small_batches(query) for name, query in QUERIES.items()}

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": sql.JACCARD,
    "op4_mix_sources": sql.MIX,
    "op8_chat_formatting": sql.PERSPECTIVES,
    "op9_benchmark_decontamination": sql.CONTAMINATION,
    "op11_structure_repair": sql.STRUCTURE_REPAIR,
    "op12_filter_audit": sql.FILTER_AUDIT,
}
