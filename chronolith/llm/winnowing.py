"""Benchmark decontamination by winnowing (op9).

Words are lower-cased alphanumeric runs. Of every text's k-grams of words, the
smallest hash in each window of ``span - k + 1`` consecutive k-grams is kept, the
rightmost among equals. Any ``span`` words that two texts share make the same
choice in both, so each shared span has a common fingerprint. Fingerprints meet in
a join; a hit carries the words around it and is extended to both sides, and only
runs of ``span`` equal words count. Items of fewer words are one window each: for
each such length, all grams of that length are fingerprints.

Documents send only fingerprints that a fixed-size filter of the items' ones lets
pass. Spark picks the join: the items' side is broadcast when small by its measured
size; else both are shuffled, with skewed hashes split at run time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import hash_filter, passes, saved
from .textarrays import ALNUM, Words, grams, mix, slices, words_of

_PRINT = "array<struct<hash: bigint, len: int, whole: boolean, pos: int, core: string, left: array<string>, right: array<string>>>"


def selected(hashes: np.ndarray, whole: np.ndarray, window: int) -> np.ndarray:
    """Places of the rightmost smallest hash of every window that is whole."""
    n = len(whole)
    best, place = hashes[:n], np.arange(n)
    for j in range(1, window):
        here = hashes[j : j + n]
        take = here <= best
        best = np.where(take, here, best)
        place = np.where(take, np.arange(j, j + n), place)
    return np.unique(place[whole])


def fingerprints(w: Words, k: int, span: int, short: list[int]) -> list[tuple[int, bool, np.ndarray, np.ndarray]]:
    """(gram length, whether a gram is a window of its own, places, hashes) of a slice."""
    out = []
    g, inside = grams(w.hash, w.row, k)
    n = len(w.row) - span + 1
    if n > 0:
        places = selected(g, w.row[:n] == w.row[span - 1 :], span - k + 1)
        out.append((k, False, places, g[places]))
    for m in short:
        g, inside = grams(w.hash, w.row, m)
        places = np.flatnonzero(inside)
        out.append((m, True, places, mix(g[places] ^ np.uint64(m))))
    return out


def _describe(w: Words, length: int, whole: bool, at: int, reach: int, base: int, h: int) -> dict:
    first, last = w.first[w.row[at]], w.first[w.row[at] + 1]
    text = lambda i: w.data[w.start[i] : w.end[i]].tobytes().decode("utf-8", "replace")
    return {
        "hash": int(np.uint64(h).astype(np.int64)), "len": length, "whole": whole, "pos": int(at - base),
        "core": " ".join(text(i) for i in range(at, at + length)),
        "left": [text(i) for i in range(at - 1, max(first, at - reach) - 1, -1)],
        "right": [text(i) for i in range(at + length, min(last, at + length + reach))],
    }


def _printed(df: DataFrame, key: str, k: int, span: int, short: list[int], own_short: bool, bits: np.ndarray | None) -> DataFrame:
    """Of each row: key, a number of its own, n_words and its fingerprints, those that the filter lets pass."""
    key_type = df.schema[key].dataType.simpleString()
    sent = None if bits is None else df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let = None if sent is None else sent.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                w = words_of(part.column("text"), ALNUM)
                counts = np.diff(w.first)
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for length, whole, places, hashes in fingerprints(w, k, span, short):
                    if own_short and whole:  # an item of this length is one window; longer ones have none
                        keep = counts[w.row[places]] == length
                        places, hashes = places[keep], hashes[keep]
                    if let is not None and len(hashes):
                        keep = passes(let, hashes)
                        places, hashes = places[keep], hashes[keep]
                    reach = 0 if whole else span - length
                    for at, h in zip(places.tolist(), hashes, strict=True):
                        found[w.row[at]].append(_describe(w, length, whole, at, reach, w.first[w.row[at]], h))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(np.arange(row, row + part.num_rows)), pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.struct([("hash", pa.int64()), ("len", pa.int32()), ("whole", pa.bool_()), ("pos", pa.int32()), ("core", pa.string()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])))],
                    names=["id", "row", "n_words", "prints"],
                )
                row += part.num_rows

    return df.select(key, "text").mapInArrow(run, f"id {key_type}, row bigint, n_words bigint, prints {_PRINT}")


def _equal_run(a: str, b: str):
    """How many leading words of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, False)
    return F.when(stop > 0, stop - 1).otherwise(F.size(same)).cast("int")


def contamination(documents: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_hit, items, contaminated``.

    ``n_hit`` counts the words inside any window of ``span`` item words; ``items`` holds
    the ids, as strings in order, of the items that have an occurring window. A null
    or wordless text has no words and no hit; a wordless item never occurs. Every row
    is judged by its own text, whatever its id and with none; an item without an id counts as a hit but not in ``items``. Other columns of either table are ignored.
    """
    items = _printed(benchmark.select(F.col(item_id), F.col("text")), item_id, k, span, list(range(1, span)), True, None)
    items = saved(items.filter(F.col("n_words") > 0), "item-prints")
    prints = items.select("id", F.explode("prints").alias("p")).select("id", "p.*")
    sides = saved(
        prints.groupBy("hash", "len", "whole", "core", "left", "right").agg(F.sort_array(F.collect_set(F.col("id").cast("string"))).alias("items")),
        "item-windows",
    )
    short = sorted(r["len"] for r in sides.filter("whole").select("len").distinct().collect())  # below span, so few
    marked = saved(_printed(documents.select(doc_id, "text"), doc_id, k, span, short, False, hash_filter(sides, "hash")), "doc-prints")

    hits = marked.filter(F.size("prints") > 0).select("row", F.explode("prints").alias("p")).select("row", "p.*")
    other = sides.select("hash", "len", "whole", "core", F.col("left").alias("item_left"), F.col("right").alias("item_right"), "items")
    met = hits.join(other, ["hash", "len", "whole", "core"]).select("row", "pos", "len", "whole", "items", _equal_run("left", "item_left").alias("before"), _equal_run("right", "item_right").alias("after"))
    met = met.filter(F.col("whole") | (F.col("before") + F.col("after") + F.col("len") >= span))
    runs = met.select("row", "items", F.struct((F.col("pos") - F.col("before")).alias("a"), (F.col("pos") + F.col("len") + F.col("after")).alias("b")).alias("run"))
    by_doc = runs.groupBy("row").agg(F.sort_array(F.collect_set("run")).alias("runs"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "runs",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("to")),
        lambda acc, r: F.struct((acc["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], acc["to"]))).cast("bigint").alias("n"), F.greatest(acc["to"], r["b"]).alias("to")),
        lambda acc: acc["n"],
    )
    by_doc = by_doc.select("row", covered.alias("n_hit"), "items")
    return marked.select("id", "row", "n_words").join(by_doc, "row", "left").select(
        F.col("id").alias(doc_id), "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
