"""Mixing sources to target weights by Pareto order sampling (op4), in DataFrame functions only.

Targets: sources in code-point order, null last, weigh 3, 1, 2, repeating, and share
``share`` times all words; a target stops at ``most`` times its source's words and the
excess is shared again by weight. A document's expected copies follow its source's
target; their whole part is certain, and the fraction is its inclusion probability p
for one more. Extra copies go to documents in order of ``odds(u) / odds(p)``, u a hash
of seed and id, up to the words that the target leaves.

No source is ever sorted in one task: ranks are dealt to buckets that keep their order,
the words of each bucket are summed first, and only the bucket in which a source's
words run out is sorted. Buckets grow in number with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: documents that one bucket of ranks is meant to hold
BUCKET_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def unit(seed: str, doc_id: Column) -> Column:
    """A number in (0, 1), the same in each run: 48 bits of md5 of seed and id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def _weighted(by_source: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds ``weight`` by a source's place; places are counted by sorted partition, not in one task."""
    part = saved(by_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    sizes = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    which = (F.col("before") + F.col("place")) % len(weights)
    return part.withColumn("place", place).join(F.broadcast(before), "part").withColumn("weight", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (which + 1).cast("int")).cast("bigint")).select("source", "source_size", "weight")


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``.

    With all excess shared out, a target is ``min(most * source_size, level * weight)``:
    the level rises until the targets add up. Each round is one sum over the sources.
    """
    w = saved(_weighted(by_source, weights), "mix-weights")
    total = w.agg(F.sum("source_size")).first()[0] or 0
    budget = min(share, most) * total
    cap = F.col("source_size") * most
    level = 0.0
    while True:
        stopped = cap <= F.lit(level) * F.col("weight")
        full, rest = w.agg(F.coalesce(F.sum(F.when(stopped, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0))).first()
        after = (budget - full) / rest if rest else level
        if after <= level:
            break
        level = after
    target = F.least(cap.cast("double"), F.lit(level) * F.col("weight")) if rest else cap.cast("double")
    return w.withColumn("target", target)


def mix(documents: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, doc_id: str = "doc_id", preference: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, copies, taken``.

    ``size`` counts words (null text: 0) and ``taken = copies * size``. ``preference``
    names a column of positive weights: expected copies are in proportion to it within
    a source (null counts as 1), cut at ``most``. Documents with equal rank (repeated
    rows, null ids) go by size and stay interchangeable. Null sources are one source,
    the last. An empty table or one without words takes nothing. Other columns of
    ``documents`` are ignored; callers join on their own key.
    """
    like = F.greatest(F.coalesce(F.col(preference).cast("double"), F.lit(1.0)), F.lit(0.0)) if preference else F.lit(1.0)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), like.alias("like"))
    docs = saved(docs.withColumn("u", unit(seed, F.col("doc_id"))), "mix-sizes")
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("like")).alias("liked"), F.count(F.lit(1)).alias("rows"))
    sums = saved(sums, "mix-sums")
    goal = targets(sums.select("source", "source_size"), weights, share, most)
    goal = goal.join(sums.select("source", "liked", "rows"), goal["source"].eqNullSafe(sums["source"])).select(goal["*"], "liked", "rows").withColumnRenamed("source", "of")
    n_rows = sums.agg(F.sum("rows")).first()[0] or 0
    buckets = max(64, -(-n_rows // BUCKET_ROWS))

    expected = F.least(F.lit(float(most)), F.when(F.col("liked") > 0, F.col("target") / F.col("liked") * F.col("like")).otherwise(0.0))
    odds = lambda x: x / (1 - x)
    ranked = (
        docs.join(goal, docs["source"].eqNullSafe(goal["of"]))
        .withColumn("expected", expected)
        .withColumn("whole", F.floor("expected"))
        .withColumn("p", F.col("expected") - F.col("whole"))
        .withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), odds(F.col("u")) / odds(F.col("p"))))
        # rank / (1 + rank) lies in (0, 1) and keeps the order of ranks
        .withColumn("bucket", F.when(F.col("rank").isNotNull(), F.floor(F.col("rank") / (1 + F.col("rank")) * buckets)))
    )
    ranked = saved(ranked.select("doc_id", "of", "size", "source_size", "target", "whole", "rank", "bucket"), "mix-ranked")
    by_bucket = ranked.groupBy("of", "bucket").agg(F.sum(F.when(F.col("rank").isNotNull(), F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("target"))
    by_bucket = saved(by_bucket, "mix-buckets")
    certain = by_bucket.groupBy("of").agg(F.sum("certain").alias("certain"), F.first("target").alias("target"))
    below = F.sum("words").over(Window.partitionBy("of").orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    run = by_bucket.withColumn("below", F.coalesce(below, F.lit(0))).drop("certain", "target")
    run = run.join(certain.withColumnRenamed("of", "own"), F.col("of").eqNullSafe(F.col("own"))).select("of", "bucket", "words", "below", (F.col("target") - F.col("certain")).alias("left"))
    run = run.filter("bucket is not null").select(F.col("of").alias("run_of"), F.col("bucket").alias("run_bucket"), "below", "left", (F.col("below") + F.col("words") <= F.col("left")).alias("all_in"), (F.col("below") >= F.col("left")).alias("all_out"))
    # documents with whole copies only have no rank, and need no bucket
    plain, drawn = ranked.filter("rank is null"), ranked.filter("rank is not null")
    dealt = drawn.join(run, F.col("of").eqNullSafe(F.col("run_of")) & (F.col("bucket") == F.col("run_bucket")))
    edge = ~F.col("all_in") & ~F.col("all_out")
    so_far = F.col("below") + F.coalesce(F.sum("size").over(Window.partitionBy("of").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = lambda df, extra: df.select("doc_id", F.col("of").alias("source"), "size", "source_size", "target", (F.col("whole") + extra).cast("bigint").alias("copies"))
    # the one that crosses the target is taken if that ends nearer to it
    edges = out(dealt.filter(edge).withColumn("so_far", so_far), (F.col("so_far") + F.col("size") / 2 <= F.col("left")).cast("int"))
    rest = out(dealt.filter(~edge), F.col("all_in").cast("int")).unionByName(out(plain, F.lit(0)))
    return rest.unionByName(edges).withColumn("taken", F.col("copies") * F.col("size"))
