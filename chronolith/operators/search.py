"""Substring search over speech and screen text, by scan or through trigram postings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions import grams as G
from ..functions.text import QUOTE_SHARE, folded, holds, normalized, words
from ..plans.lineage import cut

#: fixed value: shorter queries have no trigram
TRIGRAM = G.TRIGRAM
#: texts of a block, as a power of two: what a posting list spans at most and a search opens at least
BLOCK_BITS = 16
#: quotes of so many words are judged by counts alone: without the first and the last one 60% are left
COUNTED = 5
#: folders that posting lists are divided among by their gram
BUCKETS = 32
#: parts of a bucket that are sorted apart, so that tasks are more than buckets
PARTS = 8
#: blocks that a query names one by one; where more have hits, the join alone picks their texts
OPENED = 2000


def corpus(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """``series, kind, t, ref, body, place``: speech, then frames that have screen text."""
    speech = segments.select("series", F.lit("speech").alias("kind"), F.col("t0").alias("t"), F.concat(F.lit("seg#"), F.col("i").cast("string")).alias("ref"), F.col("text").alias("body"), F.col("i").cast("bigint").alias("place"))
    screen = frames.filter("ocr is not null and ocr <> ''").select("series", F.lit("screen").alias("kind"), "t", F.col("id").alias("ref"), F.col("ocr").alias("body"), F.col("place").cast("bigint").alias("place"))
    return speech.unionByName(screen)


def scan(body: DataFrame, query: str, limit: int) -> DataFrame:
    """Hits of a query of three characters or more: in order of time, letters of either case, no other folding."""
    return body.filter(F.lower("body").contains(query.strip().lower())).orderBy("t", "series", "ref").limit(limit)


def scan_short(body: DataFrame, query: str, limit: int) -> DataFrame:
    """Hits of a short query: the first ones, speech before screen, then in order of time; one Cyrillic pair is folded."""
    needle = query.strip().lower().replace("ё", "е")
    first = body.filter(folded(F.col("body")).contains(needle)).orderBy(F.when(F.col("kind") == "speech", 0).otherwise(1), "place", "series", "ref").limit(limit)
    return first.orderBy("t", "series", "ref")


def search(body: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return (scan_short if len(query.strip()) < TRIGRAM else scan)(body, query, limit)


def postings(body: DataFrame) -> DataFrame:
    """``gram, series, ref``: each trigram of each text once."""
    low = body.select("series", "ref", F.lower("body").alias("low"))
    return low.mapInArrow(_listed_grams, low.drop("low").withColumn("grams", F.array(F.lit(""))).schema).select("series", "ref", F.explode("grams").alias("gram"))


def _listed_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in G.slices(batch, "low"):
            yield pa.RecordBatch.from_arrays([part.column("series"), part.column("ref"), G.of_each_text(part.column("low"))], ["series", "ref", "grams"])


def search_postings(index: DataFrame, body: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """What ``scan`` finds, but only texts with all grams of the query are looked at."""
    low = query.strip().lower()
    grams = sorted({low[i : i + TRIGRAM] for i in range(len(low) - TRIGRAM + 1)})
    held = index.filter(F.col("gram").isin(grams)).groupBy("series", "ref").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams))
    # worked out once: a semi-join is carried into every part of a union, and what it asks for with it
    return scan(body.join(cut(held.select("series", "ref")), ["series", "ref"], "left_semi"), query, limit)


def numbered(body: DataFrame) -> DataFrame:
    """A corpus with ``doc``, a number that goes up with series and place, and ``block``, the run of 2**``BLOCK_BITS`` numbers it lies in.

    Numbers depend on how rows are dealt out: they hold for what is written of them at once.
    """
    placed = body.drop("doc").repartitionByRange("series", "kind", "place").sortWithinPartitions("series", "kind", "place")
    return placed.withColumn("doc", F.monotonically_increasing_id()).withColumn("block", F.shiftright("doc", BLOCK_BITS))


def bucket_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def packed_postings(body: DataFrame) -> DataFrame:
    """``bucket, gram, block, n, first, gaps``: of each trigram and block the numbers of texts that hold it, as the first one and differences.

    A list has at most 2**``BLOCK_BITS`` numbers, however often a gram occurs. Tasks make a list of each slice of
    their texts, so what is dealt out by gram are lists. Rows come sorted by bucket, gram and block, a gram in one task.
    """
    pieces = body.select("block", "doc", F.lower("body").alias("low")).mapInArrow(_slice_lists, "gram string, block bigint, least bigint, beyond array<int>")
    dealt = pieces.withColumn("bucket", bucket_of(F.col("gram"))).withColumn("part", F.pmod(F.shiftright(F.xxhash64("gram"), 32), F.lit(PARTS)))
    placed = dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "gram", "block", "least")
    return placed.drop("part").mapInArrow(_joined_lists, "bucket int, gram string, block bigint, n int, first bigint, gaps array<int>")


def _slice_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in G.slices(batch, "low"):
            gram, block, least, beyond = G.listed(part.column("low"), *(np.asarray(part.column(c)) for c in ("block", "doc")))
            yield pa.RecordBatch.from_arrays([gram, pa.array(block, pa.int64()), pa.array(least, pa.int64()), beyond], ["gram", "block", "least", "beyond"])


def _joined_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of one gram and block stand together; what the end of a batch may cut waits for the next one."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if kept is None else [kept, batch.cast(kept.schema)]).combine_chunks()
        if not rows.num_rows:
            continue
        batch = rows.to_batches()[0]
        at = _begins(batch)
        last = int(at[-1])
        if last:
            yield _whole_lists(batch.slice(0, last))
        kept = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.slice(last).columns], batch.schema.names)
    if kept is not None:
        yield _whole_lists(kept)


def _begins(rows: pa.RecordBatch) -> np.ndarray:
    """Where rows of another gram or block than the one before begin."""
    gram = np.asarray(rows.column("gram").dictionary_encode().indices)
    block = np.asarray(rows.column("block"))
    return np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])))


def _whole_lists(rows: pa.RecordBatch) -> pa.RecordBatch:
    begins = np.zeros(rows.num_rows, np.int64)
    begins[_begins(rows)] = 1
    at, first, gaps = G.merged(np.cumsum(begins), np.asarray(rows.column("least")), rows.column("beyond"))
    head = rows.select(["bucket", "gram", "block"]).take(pa.array(at))
    n = np.diff(np.asarray(gaps.offsets)).astype(np.int32)
    return pa.RecordBatch.from_arrays([*head.columns, pa.array(n), pa.array(first, pa.int64()), gaps], ["bucket", "gram", "block", "n", "first", "gaps"])


@F.pandas_udf(ArrayType(LongType()))
def _in_all(first: pd.Series, gaps: pd.Series) -> pd.Series:
    """Numbers that all lists of a row hold; the shortest lists meet first."""

    def one(starts: np.ndarray, lists: np.ndarray) -> np.ndarray:
        left = None
        for k in sorted(range(len(lists)), key=lambda k: len(lists[k])):
            docs = np.cumsum(lists[k], dtype=np.int64) + starts[k]
            if left is not None:
                at = np.searchsorted(docs, left)
                docs = left[docs[np.minimum(at, len(docs) - 1)] == left]
            left = docs
        return left

    return pd.Series([one(a, b) for a, b in zip(first, gaps, strict=True)])


def indexed(postings: DataFrame, body: DataFrame, query: str, limit: int = 20, live: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """What ``scan`` finds, through ``packed_postings``: ``written`` tells apart numbers of several writes on both sides.

    Only the buckets of the query's grams are opened, and of these only row groups that
    may hold them; blocks that lack a gram are passed over, lists of the others meet, and only blocks
    with texts that hold all grams are opened. ``live`` takes away rows that were replaced.
    """
    low = query.strip().lower()
    grams = sorted({low[i : i + TRIGRAM] for i in range(len(low) - TRIGRAM + 1)})
    buckets = body.sparkSession.createDataFrame([(g,) for g in grams], "gram string").select(bucket_of(F.col("gram"))).distinct().collect()  # of the query
    lists = postings.filter(F.col("bucket").isin([r[0] for r in buckets]) & F.col("gram").isin(grams))
    met = lists.groupBy("written", "block").agg(F.count("*").alias("held"), F.collect_list("first").alias("first"), F.collect_list("gaps").alias("gaps")).filter(F.col("held") == len(grams))
    docs = cut(met.select("written", "block", F.explode(_in_all("first", "gaps")).alias("doc")))
    blocks = docs.select("written", "block").distinct().limit(OPENED + 1).collect()
    if len(blocks) <= OPENED:
        body = body.filter(F.col("written").isin(sorted({b["written"] for b in blocks})) & F.col("block").isin(sorted({b["block"] for b in blocks})))
    return scan(live(body.join(docs, ["written", "block", "doc"], "left_semi")), query, limit)


def reliable_terms(frames: DataFrame, least: int = 2) -> DataFrame:
    """``series, term, n``: words of screen texts that are seen on ``least`` frames or more.

    Each text gives a word once, so rows are counted where they are, and a task sends a term once. Only
    if some id of a series comes twice, which is asked first, ids go with their words to be told apart.
    """
    terms = frames.select("series", "id", F.explode(F.array_distinct(words(F.col("ocr")))).alias("term"))
    again = frames.filter("id is not null").groupBy("series", "id").count().filter("count > 1")
    seen = F.count("id") if again.isEmpty() else F.count_distinct("id")
    return terms.groupBy("series", "term").agg(seen.alias("n")).filter(F.col("n") >= least)


def holders(quotes: DataFrame, quote_id: str, texts: DataFrame, text_id: str) -> DataFrame:
    """Pairs of a quote (its id and ``quote``) and a text (its id and ``body``) that holds it, as ``text.holds`` judges.

    A text that holds a quote lacks few of its words: what the share leaves, or the first
    and the last one if it holds the quote literally. So it has one of the quote's words
    that are in fewest texts, as many as weigh more than that; pairs come from these. For quotes of
    ``COUNTED`` words or more that is all: the words between the first and the last are the share already,
    so pairs are judged by counts of words and no text is moved. Shorter ones are judged with
    the text. Quotes of fewer than three words have no rare word that must be there and meet every text,
    as a query set. Ids are unique; null quotes and null or empty texts give no pair.
    """
    q = quotes.filter("quote is not null").select(quote_id, normalized(F.col("quote")).alias("q"), words(F.col("quote")).alias("q_words"))
    t = texts.filter("body <> ''")
    asked = q.filter(F.size("q_words") >= 3).select(quote_id, F.size("q_words").alias("total"), F.explode("q_words").alias("word")).groupBy(quote_id, "total", "word").agg(F.count(F.lit(1)).alias("n"))
    # words of quotes are numbered: numbers are dealt out and sorted in place of them
    numbers = cut(asked.select("word").distinct().withColumn("number", F.monotonically_increasing_id()))
    asked = asked.join(numbers, "word").drop("word").withColumnRenamed("number", "word")
    held = t.select(text_id, F.explode(F.array_distinct(words(F.col("body")))).alias("word"))
    known = cut(held.join(numbers, "word").select(text_id, F.col("number").alias("word")))
    often = known.groupBy("word").agg(F.count(F.lit(1)).alias("texts"))
    rare_first = Window.partitionBy(quote_id).orderBy("texts", "word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = asked.join(often, "word", "left").fillna(0, ["texts"]).withColumn("before", F.sum("n").over(rare_first) - F.col("n"))
    tenths = int(QUOTE_SHARE * 10)
    needed = 10 * F.col("before") <= F.greatest(F.lit(20), (10 - tenths) * F.col("total"))
    ranked = cut(ranked.filter("texts > 0").withColumn("first", needed))

    near = ranked.filter("first").join(known, "word")
    # what the words outside the first ones can add at most, then what they do
    counted = near.filter(F.col("total") >= COUNTED).groupBy(quote_id, text_id, "total").agg(F.sum("n").alias("hits"))
    others = ranked.filter(~F.col("first") & (F.col("total") >= COUNTED))
    most = others.groupBy(quote_id).agg(F.sum("n").alias("most"))
    counted = cut(counted.join(most, quote_id, "left").filter(10 * (F.col("hits") + F.coalesce("most", F.lit(0))) >= tenths * F.col("total")).drop("most"))
    # words of one weight in the quote meet those of the text as lists, so a pair is a row for each weight and not for each word
    lists = others.groupBy(quote_id, "n").agg(F.collect_list("word").alias("asked"))
    texts_words = known.groupBy(text_id).agg(F.collect_list("word").alias("has"))
    more = counted.drop("hits").join(lists, quote_id).join(texts_words, text_id).withColumn("hits", F.col("n") * F.size(F.array_intersect("asked", "has")))
    sums = counted.unionByName(more.select(quote_id, text_id, "total", "hits")).groupBy(quote_id, text_id, "total").agg(F.sum("hits").alias("hits"))
    by_count = sums.filter(10 * F.col("hits") >= tenths * F.col("total"))

    ids = [quote_id, text_id]
    found = by_count.select(ids)
    # whole texts are read again only for quotes that need them
    body = lambda texts: texts.select(text_id, normalized(F.col("body")).alias("h"), F.array_distinct(words(F.col("body"))).alias("h_words"))
    judged = holds(F.col("q"), F.col("q_words"), F.col("h"), F.col("h_words"))
    middle, short = q.filter(F.size("q_words").between(3, COUNTED - 1)), q.filter(F.size("q_words") < 3)
    if not middle.isEmpty():
        few = cut(near.filter(F.col("total") < COUNTED).select(ids).distinct())
        some = t.join(few.select(text_id).distinct(), text_id, "left_semi")
        found = found.unionByName(few.join(q, quote_id).join(body(some), text_id).filter(judged).select(ids))
    if not short.isEmpty():
        found = found.unionByName(short.join(body(t), judged).select(ids))
    return found
