"""Selection of moments: from a dense signal to few moments that leave no long stretch bare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import gap_target, moment_budget
from ..operators import bursts, coverage, frames, greedy
from .lineage import cut

MS = 1000
MAX_GAP_SECONDS = 15.0


def signal_of(pictures: DataFrame, delta: float, height: int, width: int) -> DataFrame:
    """``series, i, t, change, change_global, pixels, seen`` of frames ``series, i, t, pixels`` (t in ms).

    ``change`` is what the most changed cell has over its own baseline; ``seen`` flags the
    pixels of cells that are not noisy.
    """
    cells = cut(frames.cell_change(pictures, delta, height, width))
    base = cut(frames.baselines(cells))
    places = frames.cell_places(height, width)
    cell_of = [next(c for c, own in enumerate(places) if p in own) for p in range(height * width)]
    seen = F.transform(F.array(*[F.lit(c + 1) for c in cell_of]), lambda c: F.element_at("baseline", c) <= frames.NOISY)
    change = frames.excess(cells, base=base).select("series", "i", "change", "change_global")
    masks = base.select("series", seen.alias("seen"))
    return pictures.select("series", "i", "t", "pixels").join(change, ["series", "i"]).join(masks, "series")


def _ms(seconds: Column) -> Column:
    return F.rint(seconds * MS).cast("bigint")


def select_moments(signal: DataFrame, durations: DataFrame, delta: float, fps: float = 4.0, max_gap: float = MAX_GAP_SECONDS, cap: int = 0, cues: DataFrame | None = None, keyframes: bool = False) -> DataFrame:
    """``series, t, reason, change`` (t in ms) of the moments to show.

    ``signal`` as of ``signal_of``, ``durations`` (series, duration in ms), ``cues`` (series, t).
    In this order: bursts and where they settle, long bursts cut by novelty, close ones
    thinned, an anchor at 0, equal screens merged, cues, grid points in bare stretches,
    and the budget (``cap``, or by duration). With ``keyframes`` each sample is a candidate.
    """
    signal = cut(signal)  # read at five places below; its pixel arithmetic is the dear part
    merge, min_gap = int(bursts.MERGE_SECONDS * MS), int(greedy.MIN_GAP_SECONDS * MS)
    plain = signal.select("series", "i", "t", "change")
    if keyframes:
        caught = plain.select("series", "t", "change")
    else:
        found = bursts.settled(plain, bursts.sessions(plain, bursts.ACTIVE, merge), bursts.QUIET, round(bursts.MERGE_SECONDS * fps))
        span = found.select("series", "burst", F.explode(F.sequence("i_from", "i_settle")).alias("i"))
        inside = cut(span.join(plain, ["series", "i"]))
        strength = inside.groupBy("series", "burst").agg(F.max("change").alias("strength"))
        picked = greedy.split_bursts(inside.select("series", "burst", "i", "t", "change"), int(greedy.SPLIT_SECONDS * MS), greedy.NOVELTY, min_gap)
        caught = picked.join(strength, ["series", "burst"]).select("series", "t", F.col("strength").alias("change"))
    caught = cut(greedy.thin_close(caught, min_gap).withColumn("reason", F.lit("change")))

    # an anchor where nothing is caught early
    early = durations.select("series").join(caught.groupBy("series").agg(F.min("t").alias("first")), "series", "left")
    anchors = early.filter(F.col("first").isNull() | (F.col("first") > min_gap)).select("series", F.lit(0).cast("bigint").alias("t"), F.lit(0.0).alias("change"), F.lit("grid").alias("reason"))
    shown = caught.unionByName(anchors)
    nearest = signal.select("series", F.col("t").alias("t"), "pixels", "seen")
    with_screen = shown.join(nearest, ["series", "t"], "left")
    blank = with_screen.filter("pixels is null").drop("pixels", "seen")  # an anchor before the first sample: its screen never counts
    some = signal.groupBy("series").agg(F.first("pixels").alias("pixels"), F.first("seen").alias("seen"))
    with_screen = with_screen.filter("pixels is not null").unionByName(blank.join(some, "series"))
    kept = cut(greedy.drop_same_screens(with_screen.select("series", "t", "reason", "change", "pixels", "seen"), delta).select("series", "t", "reason", "change"))

    if cues is not None:
        inside_cues = cues.join(durations, "series").filter((F.col("t") >= 0) & (F.col("t") <= F.col("duration"))).select("series", "t")
        anchored = greedy.cue_anchors(inside_cues, kept, int(greedy.CUE_SECONDS * MS))
        kept = kept.unionByName(anchored.select("series", "t", F.lit("cue").alias("reason"), F.lit(0.0).alias("change")))

    seconds = F.col("duration") / MS
    goals = durations.select("series", "duration", _ms(gap_target(seconds, max_gap)).alias("goal"), (F.lit(cap) if cap > 0 else moment_budget(seconds)).alias("cap"))
    timed = kept.join(goals, "series")
    by_time = Window.partitionBy("series").orderBy("t")
    edges = timed.select("series", "goal", F.coalesce(F.lag("t").over(by_time), F.lit(0)).cast("bigint").alias("a"), F.col("t").alias("b"))
    ends = timed.groupBy("series").agg(F.max("t").alias("a"), F.max("duration").alias("b"), F.max("goal").alias("goal")).select("series", "goal", "a", "b")
    wide = edges.unionByName(ends).filter(F.col("b") - F.col("a") > F.col("goal")).withColumn("n", F.expr("(b - a) div goal"))
    grid = wide.select("series", "a", "b", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("k")).select("series", F.expr("a + ((b - a) * k) div (n + 1)").alias("t"), F.lit("grid").alias("reason"), F.lit(0.0).alias("change"))
    all_of = kept.unionByName(grid).join(goals, "series")
    return greedy.fit_budget(all_of.select("series", "t", "reason", "change", "cap", "duration", F.col("goal").alias("max_gap")))


def report(moments: DataFrame, durations: DataFrame, max_gap: float = MAX_GAP_SECONDS) -> DataFrame:
    """Of each series its moments by reason, longest stretch, coverage in millionths of the duration, and completeness."""
    seconds = F.col("duration") / MS
    timed = moments.join(durations.withColumn("goal", _ms(gap_target(seconds, max_gap))), "series")
    spans = coverage.spans(timed, F.col("duration")).join(durations.withColumn("goal", _ms(gap_target(seconds, max_gap))), "series")
    length = F.col("b") - F.col("a")
    cover = spans.groupBy("series").agg(F.max(length).alias("longest"), F.sum(F.when(length > F.col("goal"), length).otherwise(0)).alias("uncovered"), F.max("duration").alias("duration"))
    counts = moments.groupBy("series").agg(F.count(F.lit(1)).alias("n_moments"), *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in greedy.WORTH])
    out = durations.select("series").join(counts, "series", "left").join(cover, "series", "left")
    return out.withColumn("coverage_ppm", F.expr("(greatest(0, duration - uncovered) * 1000000) div duration")).withColumn("complete", F.col("uncovered") == 0)
