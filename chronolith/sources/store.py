"""The evidence store: Parquet tables of many series in generations, with JSON Lines for import and export.

A write puts the rows of the series that it touches beside older ones, in folders of its own,
and then one small manifest that names the next generation. Until the manifest is there
nobody sees the write; who reads a snapshot sees one generation of all tables. Which write
has a series' rows of a table is a table itself (``owners``), so a series is replaced
without touching others, and neither folders nor files go by series.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as finding

SCHEMAS = {
    "segments": "series string, i bigint, t0 double, t1 double, text string, tc string",
    "frames": "series string, place bigint, id string, t double, tc string, path string, w int, h int, bytes bigint, est_tokens bigint, reason string, segment_i bigint, caption string, ocr string, url string",
    "gaps": "series string, a double, b double, tc string",
    "summary": "series string, duration double, n_frames bigint, est_tokens_per_frame bigint, max_gap_target double, longest double, coverage double, complete boolean",
    "served": "series string, id string, t double, at timestamp",
    "corpus": "series string, kind string, t double, ref string, body string, place bigint, doc bigint",
    "postings": "gram string, block bigint, n int, first bigint, gaps array<int>",
}
OWNED = ("segments", "frames", "gaps", "summary", "corpus")
#: what the rows of a long series are dealt out by
ORDER = {"segments": ("i",), "frames": ("place",)}
#: how each table's files are divided further, for readers that need few of them
PARTS = {"corpus": ("block", "bigint"), "postings": ("bucket", "int")}


def read_jsonl(spark: SparkSession, path: str, table: str) -> DataFrame:
    """JSON Lines of a table; fields that a line lacks are null."""
    return spark.read.schema(SCHEMAS[table]).json(path)


class Conflict(RuntimeError):
    """Another write was finished first; nothing of this one is visible, and it can be done again."""


@dataclass
class Snapshot:
    """One generation of a store. ``writes`` has the live writes of each table, ``mixed`` the tables of which some rows were replaced."""

    spark: SparkSession
    root: str
    generation: int = 0
    owners: str | None = None
    writes: dict[str, list[str]] = field(default_factory=dict)
    mixed: list[str] = field(default_factory=list)

    def stored(self, table: str) -> DataFrame:
        """All rows that live writes of a table hold, with ``written`` and what divides the files; replaced rows are still there."""
        schema = ", ".join([SCHEMAS[table], "written string", *(" ".join(p) for t, p in PARTS.items() if t == table)])
        paths = [f"{self.root}/{table}/written={w}" for w in self.writes.get(table, [])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)

    def owned(self, table: str) -> DataFrame:
        """``series, written``: which write has the rows of a series."""
        if self.owners is None:
            return self.spark.createDataFrame([], "series string, written string")
        return self.spark.read.schema("name string, series string, written string").parquet(f"{self.root}/owners/{self.owners}").filter(F.col("name") == table).drop("name")

    def live(self, rows: DataFrame, table: str) -> DataFrame:
        """Those of ``stored`` rows that no later write has replaced."""
        return rows.join(self.owned(table), ["series", "written"], "left_semi") if table in self.mixed else rows

    def table(self, table: str) -> DataFrame:
        """The rows of a table in this generation."""
        if table == "served":
            return self.served()
        return self.live(self.stored(table), table).select(_columns(self.spark, table))

    def served(self) -> DataFrame:
        """Frames served since their series was last indexed."""
        path = _path(self.spark, f"{self.root}/served")
        if not path.getFileSystem(_conf(self.spark)).exists(path):
            return self.spark.createDataFrame([], SCHEMAS["served"])
        rows = self.spark.read.schema(SCHEMAS["served"] + ", written string, batch string").parquet(f"{self.root}/served")
        return rows.join(self.owned("summary"), ["series", "written"], "left_semi").drop("written", "batch")


def _columns(spark: SparkSession, table: str) -> list[str]:
    return spark.createDataFrame([], SCHEMAS[table]).columns


def _conf(spark: SparkSession):
    return spark._jsc.hadoopConfiguration()


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def snapshot(spark: SparkSession, root: str, generation: int | None = None) -> Snapshot:
    """The latest generation, or a given one; a store without any is empty. A manifest that was cut off counts as none."""
    folder = _path(spark, f"{root}/manifests")
    files = folder.getFileSystem(_conf(spark))
    names = sorted(s.getPath().getName() for s in files.listStatus(folder)) if files.exists(folder) else []
    for name in reversed(names):
        number = int(name.partition(".")[0]) if name.endswith(".json") else -1
        if number < 1 or generation not in (None, number):
            continue
        try:
            return Snapshot(spark, root, number, **json.loads(spark.read.text(f"{root}/manifests/{name}", wholetext=True).first()[0]))
        except (ValueError, TypeError):
            continue
    if generation:
        raise ValueError(f"{root} has no generation {generation}")
    return Snapshot(spark, root)


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return snapshot(spark, root).table(table)


def _put(df: DataFrame, root: str, table: str, written: str) -> None:
    """Writes rows of a table into the folder of one write; a reader that looks for a series passes over most row groups."""
    if table == "postings":
        placed = df.sortWithinPartitions("bucket", "gram", "block")  # as they come, which Spark does not know
    elif table == "corpus":
        placed = df
    else:
        keys = ["series", *ORDER.get(table, ())]  # a long series is cut
        placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = placed.write.partitionBy(PARTS[table][0]) if table in PARTS else placed.write
    writer.parquet(f"{root}/{table}/written={written}")


def commit(base: Snapshot, changed: dict[str, DataFrame], series: DataFrame) -> Snapshot:
    """Replaces all rows that ``series`` has in the ``changed`` tables; what they don't have any more is gone. The next generation.

    The manifest comes last and is made once: if another write got there first, ``Conflict`` is raised.
    A search corpus among the changes gets its postings. Each series of ``changed`` must be in ``series``.
    """
    spark, root, written = base.spark, base.root, uuid.uuid4().hex
    touched = series.select("series").distinct()
    for table, df in changed.items():
        _put(finding.numbered(df) if table == "corpus" else df.select(_columns(spark, table)), root, table, written)
        if table == "corpus":
            mine = Snapshot(spark, root, writes={"corpus": [written]}).stored("corpus")
            _put(finding.packed_postings(mine), root, "postings", written)
    names = spark.createDataFrame([(t,) for t in changed], "name string")
    now = names.crossJoin(touched).withColumn("written", F.lit(written))  # a row for each table
    before = None
    if base.owners is not None:
        before = spark.read.schema("name string, series string, written string").parquet(f"{root}/owners/{base.owners}")
        now = before.join(now, ["name", "series"], "left_anti").unionByName(now)
    now.write.parquet(f"{root}/owners/{written}")
    owners = spark.read.schema("name string, series string, written string").parquet(f"{root}/owners/{written}")
    writes = {r["name"]: sorted(r["w"]) for r in owners.groupBy("name").agg(F.collect_set("written").alias("w")).collect()}  # as many as there are writes
    if "corpus" in writes:
        writes["postings"] = writes["corpus"]
    mixed = set(base.mixed)
    if before is not None:
        mixed |= {r["name"] for r in before.join(owners, ["name", "series", "written"], "left_anti").select("name").distinct().collect()}
    mixed = sorted(t for t in mixed if len(writes.get(t, [])) > 1)  # of a single write nothing was replaced
    told = {"owners": written, "writes": writes, "mixed": mixed}
    at = _path(spark, f"{root}/manifests/{base.generation + 1:012d}.json")
    files = at.getFileSystem(_conf(spark))
    try:
        out = files.create(at, False)
    except Exception as e:
        if "exist" in str(e).lower():
            raise Conflict(f"generation {base.generation + 1} of {root} is there already") from e
        raise
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    return Snapshot(spark, root, base.generation + 1, **told)


def write_index(root: str, segments: DataFrame, frames: DataFrame, gaps: DataFrame, summary: DataFrame) -> Snapshot:
    """Writes all tables of the series in ``summary`` anew, and the search over them; their log of served frames starts again."""
    base = snapshot(summary.sparkSession, root)
    return commit(base, {"segments": segments, "frames": frames, "gaps": gaps, "summary": summary, "corpus": finding.corpus(segments, frames)}, summary)


def log_served(root: str, frames: DataFrame, batch: str | None = None) -> None:
    """Logs frames as served. What has the name of a ``batch`` that was logged before takes its place: a batch that is run again counts once."""
    now = snapshot(frames.sparkSession, root)
    rows = frames.select("series", "id", "t", F.current_timestamp().alias("at")).join(now.owned("summary"), "series")
    rows.write.mode("overwrite").parquet(f"{root}/served/batch={batch or uuid.uuid4().hex}")


def with_ocr(frames: DataFrame, texts: DataFrame) -> DataFrame:
    """Frames with recognised texts by path; blank texts are null, and a frame without an answer keeps what it has."""
    found = texts.select("path", F.expr("nullif(trim(text), '')").alias("new_ocr"), F.lit(True).alias("told"))
    return frames.join(found, "path", "left").withColumn("ocr", F.when(F.col("told"), F.col("new_ocr")).otherwise(F.col("ocr"))).select(frames.columns)


def with_caption(frames: DataFrame, series: str, frame_id: str, caption: str) -> DataFrame:
    """Frames with a caption on one of them; whether it is there shows in a count of the id."""
    here = (F.col("series") == series) & (F.col("id") == frame_id)
    return frames.withColumn("caption", F.when(here, F.lit(caption)).otherwise(F.col("caption")))


def put_ocr(spark: SparkSession, root: str, texts: DataFrame) -> int:
    """Stores recognised ``texts`` (path, text; one a path) with their frames and renews the search over their series; how many of those frames have text now."""
    base = snapshot(spark, root)
    touched = base.table("frames").join(texts.select("path"), "path", "left_semi").select("series").distinct()
    frames = with_ocr(base.table("frames").join(touched, "series", "left_semi"), texts)
    segments = base.table("segments").join(touched, "series", "left_semi")
    after = commit(base, {"frames": frames, "corpus": finding.corpus(segments, frames)}, touched)
    return after.table("frames").join(texts.select("path"), "path", "left_semi").filter("ocr is not null").count()


def put_caption(spark: SparkSession, root: str, series: str, frame_id: str, caption: str) -> bool:
    """Stores a caption; False, and nothing is written, if there is no such frame."""
    base = snapshot(spark, root)
    frames = base.table("frames").filter(F.col("series") == series)
    if frames.filter(F.col("id") == frame_id).isEmpty():
        return False
    commit(base, {"frames": with_caption(frames, series, frame_id, caption)}, spark.createDataFrame([(series,)], "series string"))
    return True


def compact(spark: SparkSession, root: str) -> Snapshot:
    """The same rows in one write, so that readers need not tell replaced ones apart."""
    base = snapshot(spark, root)
    every = base.owned("summary").select("series")
    return commit(base, {t: base.table(t) for t in OWNED if t in base.writes}, every)


def vacuum(spark: SparkSession, root: str) -> int:
    """Deletes manifests before the latest one and folders that it doesn't name; how many. Not beside a write or a reader of older generations."""
    now = snapshot(spark, root)
    kept = {f"{root}/{t}/written={w}" for t, ws in now.writes.items() for w in ws} | {f"{root}/owners/{now.owners}", f"{root}/manifests/{now.generation:012d}.json"}
    gone = 0
    for table in (*OWNED, "postings", "owners", "manifests"):
        folder = _path(spark, f"{root}/{table}")
        files = folder.getFileSystem(_conf(spark))
        for s in files.listStatus(folder) if files.exists(folder) else ():
            if f"{root}/{table}/{s.getPath().getName()}" not in kept:
                gone += bool(files.delete(s.getPath(), True))
    return gone
