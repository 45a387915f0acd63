"""The whole way of a series: index it, search it, look at moments, verify texts, report.

A store is a folder of Parquet tables (``sources.store``). Every function takes many
series at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import audit, coverage, lookup
from ..operators import search as finding
from ..sources import captions, store
from . import selection

BUCKET_MS = 30_000
FRAME_WIDTH = 1280


def frame_rows(moments: DataFrame, segments: DataFrame, media: DataFrame, width: int = FRAME_WIDTH) -> DataFrame:
    """Rows of the frames table for moments ``series, t (ms), reason, change``.

    Ids count a series' moments from ``f0000`` on in order of time, whether or not a
    picture could be taken. ``segments`` (series, i, t0_ms, t1_ms) gives the speech at a
    moment, ``media`` (series, width, height, url) size and link.
    """
    place = F.row_number().over(Window.partitionBy("series").orderBy("t", "reason")) - 1
    rows = moments.select("series", "t", "reason", place.cast("bigint").alias("id"))
    spoken = segments.select("series", F.col("i").cast("bigint").alias("i"), F.col("t0_ms").alias("t0"), F.col("t1_ms").alias("t1"))
    seen = lookup.segment_at(rows, spoken, BUCKET_MS).withColumnRenamed("id", "place").join(media.select("series", F.col("width").alias("sw"), F.col("height").alias("sh"), F.col("url").alias("source")), "series")
    w = F.least(F.lit(width), F.col("sw"))
    h = scalars.scaled_height(F.col("sw"), F.col("sh"), w)
    seconds = F.col("t") / 1000
    name = F.format_string("f%04d", "place")
    return seen.select(
        "series", "place", name.alias("id"), seconds.alias("t"), scalars.timecode(seconds).alias("tc"), F.concat(F.lit("frames/"), name, F.lit(".jpg")).alias("path"), w.cast("int").alias("w"), h.cast("int").alias("h"),
        F.lit(None).cast("bigint").alias("bytes"), scalars.effective_tokens(w, h).alias("est_tokens"), "reason", "segment_i", F.lit(None).cast("string").alias("caption"), F.lit(None).cast("string").alias("ocr"),
        scalars.moment_link(F.col("source"), seconds).alias("url"),
    )


def index(root: str, signal: DataFrame, segments: DataFrame, media: DataFrame, delta: float, max_gap: float = selection.MAX_GAP_SECONDS, cap: int = 0, keyframes: bool = False) -> None:
    """Selects moments of ``signal`` (as of ``selection.signal_of``) and writes the store of their series anew.

    ``segments`` as captions give them, ``media`` (series, duration in seconds, width, height, url).
    """
    durations = media.select("series", F.rint(F.col("duration") * 1000).cast("bigint").alias("duration"))
    cues = captions.pointing_cues(segments).select("series", F.col("t_ms").alias("t"))
    moments = selection.cut(selection.select_moments(signal, durations, delta, max_gap=max_gap, cap=cap, cues=cues, keyframes=keyframes))
    frames = selection.cut(frame_rows(moments, segments, media))
    told = selection.report(moments, durations, max_gap).drop("duration")
    goals = durations.select("series", "duration", F.rint(scalars.gap_target(F.col("duration") / 1000, max_gap) * 1000).cast("bigint").alias("goal"))
    bare = coverage.spans(moments.join(goals, "series"), F.col("duration")).join(goals, "series").filter(F.col("b") - F.col("a") > F.col("goal"))
    tenth = lambda c: F.rint(F.col(c) / 100) / 10
    gaps = bare.select("series", tenth("a").alias("a"), tenth("b").alias("b")).withColumn("tc", F.concat(scalars.timecode(F.col("a")), F.lit(" - "), scalars.timecode(F.col("b"))))
    per_frame = frames.groupBy("series").agg(F.max_by("est_tokens", "place").alias("est_tokens_per_frame"))
    summary = told.join(goals, "series").join(per_frame, "series", "left").select(
        "series", (F.col("duration") / 1000).alias("duration"), F.coalesce("n_moments", F.lit(0)).alias("n_frames"), F.coalesce("est_tokens_per_frame", F.lit(0)).alias("est_tokens_per_frame"),
        (F.col("goal") / 1000).alias("max_gap_target"), (F.coalesce("longest", "duration") / 1000).alias("longest"), (F.coalesce("coverage_ppm", F.lit(0)) / 1_000_000).alias("coverage"), F.coalesce("complete", F.lit(False)).alias("complete"),
    )
    spoken = segments.select("series", F.col("i").cast("bigint").alias("i"), (F.col("t0_ms") / 1000).alias("t0"), (F.col("t1_ms") / 1000).alias("t1"), "text").withColumn("tc", scalars.timecode(F.col("t0")))
    store.write_index(root, spoken, frames, gaps, selection.cut(summary))


def search(spark: SparkSession, root: str, query: str, limit: int = 20) -> DataFrame:
    """Hits in speech and screen text, with their time codes and shortened lines; a query of three characters or more goes through the index."""
    now = store.snapshot(spark, root)
    if len(query.strip()) < finding.TRIGRAM:
        hits = finding.scan_short(now.table("corpus"), query, limit)
    else:
        hits = finding.indexed(now.stored("postings"), now.stored("corpus"), query, limit, lambda rows: now.live(rows, "corpus"))
    return hits.select("series", "kind", "t", "ref", scalars.timecode_short(F.col("t")).alias("tc"), scalars.short_line(F.col("body")).alias("line"))


def frames(spark: SparkSession, root: str, probes: DataFrame | None = None, ids: DataFrame | None = None, count: int = 1, log: bool = True, batch: str | None = None) -> DataFrame:
    """Frames by ``ids`` (series, id), or the ``count`` nearest to each of ``probes`` (series, probe, at in seconds); they are logged as served, once for a ``batch`` of the same name.

    ``in_gap`` tells whether a probe lies in a stretch without frames.
    """
    now = store.snapshot(spark, root)
    rows = now.table("frames")
    if ids is not None:
        found = rows.join(ids.select("series", "id").distinct(), ["series", "id"], "left_semi").withColumn("in_gap", F.lit(False))
    else:
        ms = lambda c: F.rint(F.col(c) * 1000).cast("bigint")
        asked = probes.select("series", "probe", ms("at").alias("at"))
        near = lookup.nearest(asked, rows.select("series", F.col("place").alias("id"), ms("t").alias("t")), count)
        bare = now.table("gaps").select("series", ms("a").alias("a"), ms("b").alias("b"))
        flagged = lookup.in_gap(asked.select("series", F.col("probe").alias("id"), F.col("at").alias("t")), bare, BUCKET_MS).select("series", F.col("id").alias("probe"), F.col("gap_from").isNotNull().alias("in_gap"))
        found = near.join(flagged, ["series", "probe"]).select("series", "probe", F.col("id").alias("place"), "in_gap").join(rows, ["series", "place"])
    found = selection.cut(found)
    if log:
        store.log_served(root, found.select("series", "id", "t").distinct(), batch)
    return found.orderBy("series", *[c for c in ("probe",) if c in found.columns], "place")


def verify(spark: SparkSession, root: str, answers: DataFrame) -> DataFrame:
    """Claims of ``answers`` (series, doc_id, text) with findings against the store; see ``audit.second_look`` and ``audit.totals``."""
    now = store.snapshot(spark, root)
    return audit.audit(answers, now.table("frames"), now.table("segments"), now.table("gaps"), now.table("served").select("series", "id"))


def report(spark: SparkSession, root: str) -> DataFrame:
    """Of each series its summary, frames by reason, tokens of all frames and of a usual call, and its first eight gaps."""
    now = store.snapshot(spark, root)
    rows = now.table("frames")
    counts = rows.groupBy("series").agg(*[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("grid", "cue", "change")], F.sum("est_tokens").alias("tokens_all"))
    first = coverage.first_gaps(now.table("gaps")).groupBy("series").agg(F.transform(F.sort_array(F.collect_list(F.struct("a", "tc"))), lambda g: g["tc"]).alias("gaps"))
    out = now.table("summary").join(counts, "series", "left").join(first, "series", "left")
    return out.withColumn("tokens_call", F.col("est_tokens_per_frame") * scalars.FRAMES_PER_CALL)
