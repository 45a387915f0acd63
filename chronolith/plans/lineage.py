"""Cuts between the steps of long plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named or context.getCheckpointDir():
        return (named or context.getCheckpointDir()).rstrip("/")
    if not context.master.startswith("local") or "cluster" in context.master:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-chronolith-"))
    return context.getCheckpointDir().rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, checkpointed into the shared folder: read often they are computed once, and they outlive a lost executor."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
