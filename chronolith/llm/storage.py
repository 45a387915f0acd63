"""Intermediate tables that survive a lost executor, and fixed-size hash filters."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Size of a hash filter: 2**FILTER_BITS bits (4 MB), whatever it is built from.
FILTER_BITS = 25
#: Bytes of rows that go to a Python worker, or come from the JVM, at once, and the setting that says so.
BATCH_BYTES = "4m"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(query: Callable) -> Callable:
    """``query(spark, ...)`` with Arrow batches of ``BATCH_BYTES`` from then on, unless the session has a smaller size of its own.

    Spark's 64 MB are held twice for each task, by the JVM and by its Python worker; texts
    are worked on in slices of at most 2 MB anyway. It changes no result.
    """

    @wraps(query)
    def run(spark: SparkSession, *rest: object) -> DataFrame:
        sized = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
        if sized(spark.conf.get(BATCH_SETTING)) > sized(BATCH_BYTES):
            spark.conf.set(BATCH_SETTING, BATCH_BYTES)
        return query(spark, *rest)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session without ``spark.checkpoint.dir`` gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-chronolith-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``saved`` gave and that nothing reads any more, and lets go of finished shuffles.

    Spark deletes shuffle files when the driver's JVM finds that nothing refers to them.
    With a small heap in use that may take long, so it is asked to look now.
    """
    jvm = SparkSession.active()._jvm
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def crc_rest(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def sample_keys(documents: DataFrame, *columns: Column | str) -> DataFrame:
    """``doc_id``, the given columns, and what tells texts of one id apart: ``n_bytes`` and ``t``, a hash."""
    return documents.filter("text is not null and doc_id is not null").select("doc_id", *columns, F.octet_length("text").cast("bigint").alias("n_bytes"), F.xxhash64("text").alias("t"))


def sample_rows(documents: DataFrame, keys: DataFrame, group: str, limit: int, most_bytes: int) -> list:
    """Rows ``doc_id, <group>, place, text`` of a sample that is the same in each run.

    ``keys`` comes from ``sample_keys`` and has a column ``group``. Of each group at most
    ``limit`` ids come, those of the smallest hash, whatever the length of their texts; the
    sample ends where the next text would take it over ``most_bytes``. A text that is
    longer than that alone is passed over. An id comes once in a group, with the text of the
    smallest hash. Groups are counted first, so that only hashes below
    a share that holds ``limit`` of them (with a tenth and six deviations to spare) are ranked:
    no group meets in one task. The few chosen ids are broadcast, and no text is shuffled
    but the chosen ones.
    """
    keys = saved(keys.filter(F.col("n_bytes") <= most_bytes).select("doc_id", group, "n_bytes", "t", F.xxhash64("doc_id").alias("h")), "sample-keys")
    counted = keys.groupBy(group).agg(F.approx_count_distinct("h", 0.02).alias("ids")).collect()  # repeated rows are one id
    low = F.lit(False)
    for r in counted:
        share = min(1.0, 1.1 * (limit + 6 * limit**0.5 + 50) / max(r["ids"], 1))
        low = low | (F.col(group).eqNullSafe(F.lit(r[group])) & (F.lit(0.5) + F.col("h") / F.lit(2.0**64) <= share))
    once = keys.filter(low).groupBy(group, "doc_id", "h").agg(F.min(F.struct("t", "n_bytes")).alias("one"))
    of_group = Window.partitionBy(group).orderBy("h", "doc_id")
    ranked = once.select("doc_id", group, "h", "one.t", "one.n_bytes", F.row_number().over(of_group).alias("place")).filter(F.col("place") <= limit)
    chosen = ranked.withColumn("held", F.sum("n_bytes").over(of_group)).filter(F.col("held") <= most_bytes).select("doc_id", group, "place", "t")
    texts = documents.filter("text is not null").select("doc_id", "text", F.xxhash64("text").alias("t")).join(F.broadcast(chosen), ["doc_id", "t"])  # limit rows a group
    rows = texts.groupBy("doc_id", group, "place").agg(F.min("text").alias("text")).collect()
    return sorted(rows, key=lambda r: (r[group], r["place"]))


def hash_filter(df: DataFrame, hashed: str) -> np.ndarray:
    """Bits set at the low ``FILTER_BITS`` of a bigint hash column.

    What comes to the driver is the filter, at most 2**FILTER_BITS bits, however
    many rows there are. A full filter lets everything pass, which costs time only.
    """
    bit = F.col(hashed).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = (
        df.select(F.shiftright(bit, 5).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(31)).cast("int")).alias("mask"))
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
        .toArrow()
    )
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().astype(np.uint32)
    return out


def passes(filter_words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the int64/uint64 hashes have their bit set."""
    bit = hashes.view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
    return (filter_words[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as make it a new column."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


def split_by(documents: DataFrame, key: Column, named: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Rows whose key is surely not in the one column of ``named``; all others, with the key beside them; its name.

    Only the others, the named ones and a few more, need an exact join, so the texts of
    most rows are never shuffled. Rows with a null key are surely not named.
    """
    hashed = named.select(F.xxhash64(F.col(named.columns[0])).alias("h"))
    sent = documents.sparkSession.sparkContext.broadcast(hash_filter(hashed, "h"))  # of fixed size

    @F.pandas_udf("boolean")
    def may_be(h: pd.Series) -> pd.Series:
        return pd.Series(passes(sent.value, h.to_numpy().astype(np.int64)))

    name = free_name(documents, "key")
    keyed = documents.withColumn(name, key)
    test = F.col(name).isNotNull() & may_be(F.xxhash64(name))
    return keyed.filter(~test).drop(name), keyed.filter(test), name
