"""Caption sources: subtitle files as rows ``series, raw`` become ``series, i, t0_ms, t1_ms, text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cue_midpoint
from ..functions.text import bare_text, points_at_screen
from ..operators import scans

_EVENTS = "struct<events: array<struct<tStartMs: double, dDurationMs: double, segs: array<struct<utf8: string>>>>>"
#: fixed value: characters from which a line that grows at its end is one rolling caption
ROLLING_MIN = 10


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def is_json3(path: Column, raw: Column) -> Column:
    """Whether a file is of the JSON kind, by its name or its first character."""
    return path.endswith(".json3") | F.ltrim(raw).startswith("{")


def json3_segments(files: DataFrame) -> DataFrame:
    """Events of JSON captions with text, in order; rolling ones are merged."""
    events = files.select("series", F.posexplode(F.from_json("raw", _EVENTS)["events"]).alias("pos", "e")).filter("e.segs is not null")
    text = _spaced(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    start = F.coalesce("e.tStartMs", F.lit(0.0))
    rows = events.select("series", "pos", F.rint(start).cast("bigint").alias("t0_ms"), F.rint(start + F.coalesce("e.dDurationMs", F.lit(0.0))).cast("bigint").alias("t1_ms"), text.alias("text"))
    return merge_rolling(rows.filter("text <> ''"))


def vtt_time(value: Column, strict: bool = True) -> Column:
    """Milliseconds of ``HH:MM:SS.mmm``; null without one. ``strict`` off also reads ``MM:SS.mmm``."""
    # fixed value: clocks of WebVTT and SRT
    pattern = r"(\d{1,2}):(\d{2}):(\d{2})[.,](\d{1,3})" if strict else r"(?:(\d{1,2}):)?(\d{2}):(\d{2})[.,](\d{1,3})"
    part = lambda i: F.coalesce(F.regexp_extract(value, pattern, i).try_cast("bigint"), F.lit(0))
    ms = F.rpad(F.regexp_extract(value, pattern, 4), 3, "0").try_cast("bigint")
    return F.when(value.rlike(pattern), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + ms)


def vtt_segments(files: DataFrame, strict: bool = True) -> DataFrame:
    """Cues of VTT or SRT captions. A cue is a timing line and the lines up to a blank one; cues without a readable start are dropped."""
    lines = files.select("series", F.posexplode(F.split("raw", r"\r\n|[\n\r]")).alias("pos", "raw")).withColumn("line", F.regexp_replace("raw", r"(?U)^\s+|\s+$", ""))
    timing = F.col("line").contains("-->")
    order = Window.partitionBy("series").orderBy("pos")
    marked = lines.withColumn("timing", timing).withColumn("block", F.sum((timing | (F.col("line") == "")).cast("int")).over(order))
    kept = ~F.col("timing") & (F.col("line") != "") & ~F.upper("line").rlike("^(WEBVTT|KIND:|LANGUAGE:|NOTE)") & ~F.col("line").rlike(r"(?U)^\d+$")
    cues = marked.groupBy("series", "block").agg(
        F.max(F.when(F.col("timing"), F.col("line"))).alias("times"), F.min("pos").alias("pos"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(kept, F.struct("pos", "line")))), lambda x: x["line"]), " ").alias("body"),
    )
    t0 = vtt_time(F.split_part("times", F.lit("-->"), F.lit(1)), strict)
    t1 = vtt_time(F.split_part("times", F.lit("-->"), F.lit(2)), strict)
    rows = cues.filter("times is not null and body <> ''").select("series", "pos", t0.alias("t0_ms"), F.coalesce(t1, t0).alias("t1_ms"), bare_text(_spaced(F.col("body"))).alias("text"))
    return merge_rolling(rows.filter("t0_ms is not null and text <> ''"))


def caption_segments(files: DataFrame, strict: bool = True) -> DataFrame:
    """Segments of caption files ``series, path, raw`` of either kind, as each file's name or first character tells."""
    kind = is_json3(F.coalesce("path", F.lit("")), F.coalesce("raw", F.lit("")))
    return json3_segments(files.filter(kind)).unionByName(vtt_segments(files.filter(~kind), strict))


def merge_rolling(rows: DataFrame) -> DataFrame:
    """``series, pos, t0_ms, t1_ms, text`` with each repeated or growing line merged into one, numbered anew.

    A merged line's text is its last one, so comparing with the row before is enough.
    """
    before, block = F.col("before_.text"), scans.block_of(F.col("pos"))
    goes_on = (F.col("text") == before) | (F.col("text").startswith(before) & (F.length(before) >= ROLLING_MIN))
    blocks = scans.running(scans.lagged(rows, block, ["pos"], ["text"]), block, ["pos"], F.coalesce(~goes_on, F.lit(True)).cast("int"), "block")
    merged = blocks.groupBy("series", "block").agg(F.min_by("t0_ms", "pos").alias("t0_ms"), F.max("t1_ms").alias("t1_ms"), F.max_by("text", "pos").alias("text"))
    return merged.select("series", (F.col("block") - 1).cast("bigint").alias("i"), "t0_ms", "t1_ms", "text")


def transcript(segments: DataFrame) -> DataFrame:
    """``series, body``: all texts in order."""
    lines = F.sort_array(F.collect_list(F.struct("i", "text")))
    return segments.groupBy("series").agg(F.array_join(F.transform(lines, lambda x: x["text"]), " ").alias("body"))


def pointing_cues(segments: DataFrame) -> DataFrame:
    """``series, t_ms``: middles of segments whose words point at the screen, each once."""
    return segments.filter(points_at_screen(F.col("text"))).select("series", cue_midpoint(F.col("t0_ms"), F.col("t1_ms")).alias("t_ms")).distinct()
