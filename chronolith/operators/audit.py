"""Audit of texts that cite moments: claims, and a finding for each broken rule.

Relations: ``answers`` (series, doc_id, text), ``frames`` (series, id, t, ocr, path),
``segments`` (series, i, t0, t1, text), ``gaps`` (series, a, b) and ``served``
(series, id). Times are seconds as doubles in claims and milliseconds inside joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalars import parse_timecode, timecode_short
from ..plans.lineage import cut
from .lookup import in_gap, near_texts

#: fixed values: seconds that a claim may be off its frame, and by which speech counts as near; tasks of a plan
TIME_TOLERANCE_MS, NEAR_MS, TASKS = 2000, 8000, 8
BUCKET_MS = 30_000
FAIL, WARN = "FAIL", "WARN"


def logical_lines(answers: DataFrame) -> DataFrame:
    """``series, doc_id, line_no, line``: lines that go on the one before are joined to it; blank lines and block marks begin anew."""
    lines = answers.select("series", "doc_id", F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("pos", "raw"))
    order = Window.partitionBy("series", "doc_id").orderBy("pos")
    blank = F.trim(F.regexp_replace("raw", r"(?U)\s+", " ")) == ""
    marked = lines.withColumn("blank", blank).withColumn("new", F.col("raw").rlike(T.BLOCK) | F.coalesce(F.lag("blank").over(order), F.lit(True)) | blank)
    placed = marked.withColumn("block", F.sum(F.col("new").cast("int")).over(order)).filter(~F.col("blank"))
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    parts = placed.groupBy("series", "doc_id", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "raw"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda x, i: F.when(i == 0, x["raw"]).otherwise(strip(x["raw"]))), " ")
    return parts.select("series", "doc_id", (F.element_at("parts", 1)["pos"] + 1).alias("line_no"), joined.alias("line"))


def claims(answers: DataFrame) -> DataFrame:
    """``series, doc_id, n, line_no, text, t, frame_id, quotes``: a claim for each citation, numbered through a text."""
    cited = logical_lines(answers).withColumn("tags", T.tags(F.col("line"))).select("series", "doc_id", "line_no", T.claim_text(F.col("line")).alias("text"), F.posexplode("tags").alias("place", "tag"))
    n = F.row_number().over(Window.partitionBy("series", "doc_id").orderBy("line_no", "place"))
    return cited.select("series", "doc_id", n.alias("n"), "line_no", "text", parse_timecode(F.col("tag.time")).alias("t"), F.col("tag.frame").alias("frame_id"), T.quotes(F.col("text")).alias("quotes"))


def audit(answers: DataFrame, frames: DataFrame, segments: DataFrame, gaps: DataFrame, served: DataFrame) -> DataFrame:
    """Claims with ``findings`` (array of code, severity, detail), ``severity`` and ``second_look``.

    Of frames with the same id the last (by ``place``) counts. Findings come in the order
    not found, time, gap, never opened, quotes.
    """
    ms = lambda c: F.rint(F.col(c) * 1000).cast("bigint")
    own = frames.groupBy("series", F.col("id").alias("frame_id")).agg(F.max_by(F.struct(F.col("t").alias("t"), F.coalesce("ocr", F.lit("")).alias("ocr"), F.col("path").alias("path")), "place").alias("frame"))
    opened = served.select("series", F.col("id").alias("frame_id"), F.lit(True).alias("opened")).distinct()
    base = claims(answers).withColumnRenamed("t", "claimed").join(own, ["series", "frame_id"], "left").join(opened, ["series", "frame_id"], "left")
    # claims are asked for by gaps, by speech and by themselves: texts are taken apart once
    base = cut(base.withColumn("id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("n").cast("string"))).withColumn("t", ms("claimed")))
    g = gaps.select("series", ms("a").alias("a"), ms("b").alias("b"))
    s = segments.select("series", "i", ms("t0").alias("t0"), ms("t1").alias("t1"), "text")
    seen = near_texts(in_gap(base.withColumnRenamed("text", "claim"), g, BUCKET_MS), s, NEAR_MS, BUCKET_MS)
    has = F.col("frame").isNotNull()
    finding = lambda when, code, severity, detail: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.alias("detail")))
    off = F.abs(F.rint(F.col("frame.t") * 1000) - F.col("t")) > TIME_TOLERANCE_MS
    ocr = F.coalesce(F.col("frame.ocr"), F.lit(""))
    fixed = F.array(
        finding(F.col("frame_id").isNotNull() & ~has, "FRAME_NOT_FOUND", FAIL, F.col("frame_id")),
        finding(has & off, "TIME_MISMATCH", FAIL, F.concat_ws(" ", timecode_short(F.col("claimed")), timecode_short(F.col("frame.t")))),
        finding(F.col("gap_from").isNotNull(), "IN_COVERAGE_GAP", FAIL, timecode_short(F.col("gap_from") / 1000)),
        finding(has & F.col("opened").isNull(), "NEVER_OPENED", WARN, F.col("frame_id")),
    )
    unheard = F.filter("quotes", lambda q: ~T.quote_supported(q, ocr) & ~T.quote_supported(q, F.col("near")))
    on_screen = has & (ocr != "")
    code = F.when(on_screen, "QUOTE_NOT_ON_SCREEN").when(F.col("near") != "", "QUOTE_NOT_IN_SPEECH")
    quoted = F.transform(unheard, lambda q: F.when(code.isNotNull(), F.struct(code.alias("code"), F.lit(WARN).alias("severity"), F.substring(q, 1, 60).alias("detail"))))
    out = seen.withColumn("findings", F.filter(F.concat(fixed, quoted), lambda f: f.isNotNull()))
    worst = F.when(F.exists("findings", lambda f: f["severity"] == FAIL), FAIL).when(F.size("findings") > 0, WARN).otherwise("OK")
    out = out.withColumn("severity", worst).withColumn("second_look", (F.col("severity") != FAIL) & F.col("frame_id").isNotNull())
    return out.select("series", "doc_id", "n", "line_no", F.col("claim").alias("text"), F.col("claimed").alias("t"), "frame_id", "quotes", "findings", "severity", "second_look", F.col("frame.path").alias("frame_path"))


def second_look(audited: DataFrame, limit: int = TASKS) -> DataFrame:
    """Tasks for a reviewer who sees nothing but claim and frame: the first ``limit`` of each text."""
    order = Window.partitionBy("series", "doc_id").orderBy("n")
    first = audited.filter(F.col("second_look") & F.col("frame_path").isNotNull()).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return first.select("series", "doc_id", F.col("n").alias("claim_id"), F.col("text").alias("claim_text"), "frame_path", "frame_id")


def totals(audited: DataFrame) -> DataFrame:
    """Of each text its claims, failures, warnings, and claims that are left for a second look."""
    of = lambda s: F.count_if(F.col("severity") == s)
    return audited.groupBy("series", "doc_id").agg(F.count(F.lit(1)).alias("claims"), of(FAIL).alias("fails"), of(WARN).alias("warns"), F.count_if("second_look").alias("second_looks"))
