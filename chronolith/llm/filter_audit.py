"""What five filters remove together, in every order (op12).

Four filters look at one text alone and are a mask of bits. The fifth takes copies: rows
are routed by the xxhash of their text to partitions of an RDD, where each hash has a
chain of the full texts that share it, with the least id of each; all other ids are
emitted. Rows then count by mask, and a vector of counts tells all orders of the filters
at once: what a filter removes after others is the sum over masks that hold its bit
and none of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .storage import saved, split_by

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: bytes of texts that a task holds before it passes its least ids on
HELD_BYTES = 32 << 20
#: bytes of shared texts that one routed partition should get
ROUTED_BYTES = 64 << 20
RESULT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"

#: rows of one id, part and mask, and how many there are
Tags = dict[tuple[int, str, int], int]


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    fails = [
        n < 100,
        100 * F.size(F.array_distinct(words)) < 80 * n,
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def _meet(chain: list[list], text: str, tags: Tags) -> Tags:
    """Puts rows of one id into the chain of their hash; the rows that are copies by that, the chain's own or the new ones."""
    entry = next((e for e in chain if e[0] == text), None)
    if entry is None:
        chain.append([text, tags])
        return {}
    (new, *_), (least, *_) = next(iter(tags)), next(iter(entry[1]))
    if new == least:
        for tag, n in tags.items():
            entry[1][tag] = entry[1].get(tag, 0) + n
        return {}
    lose, entry[1] = (tags, entry[1]) if new > least else (entry[1], tags)
    return {(i, part, mask | COPY): n for (i, part, mask), n in lose.items()}


def _least_of_task(rows: Iterator[Row]) -> Iterator[tuple[tuple[int, int], tuple[str | None, Tags]]]:
    """Of each text the rows of the least id that this task has seen, keyed by hash; all others have a smaller copy already.

    Those go along without their text, keyed by their id, as they meet nothing any more.
    Held texts are bounded: when they pass the bound, all go on and the task starts anew.
    """
    held: dict[int, list[list]] = {}
    size = 0
    for r in rows:
        chain = held.setdefault(r.h, [])
        known = len(chain)
        if copies := _meet(chain, r.text, {(r.doc_id, r.part, r.mask): 1}):
            yield (next(iter(copies))[0], 1), (None, copies)
        size += (len(r.text) + 200) * (len(chain) - known)
        if size > HELD_BYTES:
            yield from (((h, 0), (text, tags)) for h, chain in held.items() for text, tags in chain)
            held, size = {}, 0
    yield from (((h, 0), (text, tags)) for h, chain in held.items() for text, tags in chain)


def _chains(routed: Iterator[tuple[tuple[int, int], tuple[str | None, Tags]]]) -> Iterator[tuple[int, str, int, int]]:
    """All rows, with the bit of copies on those whose id is not the least of their text; hashes come in order, one chain at a time."""
    at: tuple[int, int] | None = None
    chain: list[list] = []
    for key, (text, tags) in routed:
        if text is None:
            yield from ((*tag, n) for tag, n in tags.items())
            continue
        if key != at:
            yield from ((*tag, n) for _, least in chain for tag, n in least.items())
            at, chain = key, []
        yield from ((*tag, n) for tag, n in _meet(chain, text, tags).items())
    yield from ((*tag, n) for _, least in chain for tag, n in least.items())


def non_minimum(shared: DataFrame, partitions: int) -> RDD:
    """``(doc_id, part, mask, n)`` of all rows of ``h, doc_id, part, mask, text``: mask has the bit of copies where a smaller id has the same text."""
    routed = shared.rdd.mapPartitions(_least_of_task)
    return routed.repartitionAndSortWithinPartitions(partitions, lambda key: key[0] * 0x9E3779B1 >> 7).mapPartitions(_chains)


def masks(documents: DataFrame) -> DataFrame:
    """``doc_id, part, mask, n``: the filters that texts fail, their language, and how many rows are alike in all three.

    A null text is empty, a null language the empty string. A row is a copy if some row
    with a smaller id has the very same text: a null id is neither smaller nor larger than others,
    so such rows are no copies, nor are repeats of one row of the least id. Other
    columns are ignored. Only texts whose hash comes twice are shuffled (all, if they
    are more than a filter of fixed size can tell).
    """
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text_mask(F.col("text")).alias("mask"), text.alias("text"))
    lean = documents.filter("doc_id is not null").select(F.xxhash64(text).alias("h"), F.octet_length(text).alias("n"))
    twice = saved(lean.groupBy("h").agg(F.count("*").alias("c"), F.max("n").alias("n")).filter("c > 1"), "twice")
    size = twice.agg(F.sum("n")).first()[0] or 0
    alone, maybe, name = split_by(rows, F.when(F.col("doc_id").isNotNull(), F.xxhash64("text")), twice.select("h"))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // ROUTED_BYTES)
    shared = maybe.select(F.col(name).alias("h"), "doc_id", "part", "mask", "text")
    tagged = spark.createDataFrame(non_minimum(shared, partitions), "doc_id bigint, part string, mask int, n int", verifySchema=False)
    return alone.select("doc_id", "part", "mask", F.lit(1).alias("n")).unionByName(tagged)


def _vector(counted: tuple[int, int, int, int]) -> np.ndarray:
    return _add(np.zeros((3, 1 << len(FILTERS)), np.int64), counted)


def _add(vector: np.ndarray, counted: tuple[int, int, int, int]) -> np.ndarray:
    vector[:, counted[0]] += counted[1:]
    return vector


def orders(part: str, vector: np.ndarray) -> Iterator[tuple]:
    """Rows of all orders and steps from counts (all, good, toxic) by mask."""
    mask = np.arange(1 << len(FILTERS))
    rows, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            now = (mask & bit != 0) & (mask & before == 0)
            removed, good, toxic = (int(v[now].sum()) for v in vector)
            redundant = int(vector[0][(mask & bit != 0) & (mask & before != 0)].sum())
            before |= bit
            rows.append((part, "".join(order), step, int(vector[0][mask & before == 0].sum()), removed, redundant, int(vector[0][bit]), good, toxic))
            shapley[name] += removed
    yield from ((*r, shapley[r[1][r[2] - 1]]) for r in rows)


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    ``masks`` says what fails. A document is good (toxic) if any row of ``labels`` with
    its id has quality 1 (toxic 1); a null id has no label. Repeated rows count each. Without
    documents there are no parts and no rows. Rows of one id, language and mask are
    counted before they meet labels, and those of one part and mask before vectors
    are merged, so no key is hot.
    """
    spark = documents.sparkSession
    counted = masks(documents).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    told = labels.filter("doc_id is not null").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    sums = [F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("quality", "toxic"))]
    by_mask = counted.join(told, "doc_id", "left").groupBy("part", "mask").agg(*sums)
    vectors = by_mask.rdd.map(lambda r: (r.part, (r.mask, r.n, r.quality, r.toxic))).combineByKey(_vector, _add, lambda a, b: a + b)
    return spark.createDataFrame(vectors.flatMap(lambda kv: orders(*kv)), RESULT, verifySchema=False)
