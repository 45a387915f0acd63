"""Exact n-gram Jaccard join over a token-group matrix (op3).

A document is its set of distinct word shingles, hashed to 64 bits. Documents with the
same set (by size and two independent 64-bit sums) are one class and one query.

1. Classes that share a band of min-hashes are one group, linked or not. Its head is the
   one that meets most others in its bands, so the one nearest to what the group has in
   common; members that link with a head of their bands are connected from here on.
2. Inside a group, members are told apart by their difference from the shingles that
   most members have. If two differences together are small enough, both members link
   with the member of the smallest one; if not, linked members have some of their
   differing shingles in common: a rare one, or enough frequent ones. Members are joined
   on rare ones alone; by frequent ones members fall into kinds, and kinds are joined on
   the first shingles of each.
3. Between groups (from here on the connected members of one), the matrix holds, for every
   shingle and group, whether a member has it among its leading shingles in a fixed order
   of all shingles (rare ones by hash first, then dense ones). A set of n shingles with a
   partner at ratio r keeps n - ceil(r n) + l leading ones, l = floor(n / 10) + 1; two
   linked sets have at least as many leading ones in common as ``least_leading`` says.
   At most as many of them are dense (in ``MANY`` sets or more) as either has dense ones.
   So where that is too few, a rare one is in common, and rare ones alone are joined.
4. Only (query, group) cells that reach the bound are opened, and the query is compared
   with the members, by whole sets. What is connected already needs no comparison: a
   group's head is compared first, and the others only where query and group are still
   apart.

The order of shingles never changes what is found: it only keeps shingles of common
passages out of the matrix. No pairs inside a group are made, and a group's common
shingles are one cell, however many members have them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import hash_filter, passes, saved
from .textarrays import GRAM_KEYS, grams, mix, slices, words_of

NUM, DEN = 80, 100
WIDTH = 5
BANDS = 4
#: shingles of one block in which dense ones are looked for
BLOCK = 2 << 20
#: a shingle is dense in so many sets; it comes last in the order if it is met so often in blocks that have it SEEN times
MANY = 16
SEEN = 3


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text."""
    w = words_of(texts)
    g, _ = grams(w.hash, w.row, width)
    out = []
    first = w.first.tolist()
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            s = np.sort(g[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mix(np.array([(w.hash[a:b] * GRAM_KEYS[: b - a]).sum() ^ np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_common(n, num: int = NUM, den: int = DEN):
    """The fewest shingles that a set of n shares with a linked one (of its size or more)."""
    return -(-num * n // den)


def spare(n):
    return n // 10 + 1


def least_leading(n, m, num: int = NUM, den: int = DEN):
    """The fewest leading shingles that linked sets of n and m have in common, as columns.

    They share at least ``num (n + m) / (num + den)`` shingles. All that lie within the
    leading ones of the set whose leading ones end first are leading in both, so at most
    what one of the sets has behind them is missing.
    """
    behind = lambda x: F.greatest(F.lit(0), F.ceil(x * num / den) - F.floor(x / 10) - 1)
    return F.ceil((n + m) * num / (num + den)) - F.greatest(behind(n), behind(m))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate(sets) if sets else np.zeros(0, np.uint64)))


_BAND_KEYS = np.random.default_rng(977).integers(1, 1 << 63, 2 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sketch(s: np.ndarray) -> tuple[int, int, list[int]]:
    if not len(s):
        return 0, 0, []
    with np.errstate(over="ignore"):
        one = mix(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
        two = mix((s ^ (s >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F) + np.uint64(1)).sum(dtype=np.uint64)
        lows = np.array([((s * k) ^ ((s * k) >> np.uint64(31))).min() for k in _BAND_KEYS], np.uint64)
        keys = mix(lows[0::2] * np.uint64(31) + lows[1::2] + np.arange(BANDS, dtype=np.uint64))
    return int(one.view(np.int64)), int(two.view(np.int64)), keys.view(np.int64).tolist()


def sketches(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n, s1, s2, bands, dense``: dense lists (shingle, count) of a block in its last row."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def dense(kept: list[np.ndarray]) -> list[tuple[int, int]]:
        if not kept:
            return []
        found, n = np.unique(np.concatenate(kept), return_counts=True)
        many = n >= SEEN
        return list(zip(found[many].view(np.int64).tolist(), n[many].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, known = [], 0, set()
        schema = pa.schema([("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), ("dense", pa.list_(pa.struct([("token", pa.int64()), ("count", pa.int64())])))])

        def rows(ids, values):
            return pa.RecordBatch.from_arrays([ids, *[pa.array([v[i] for v in values], f.type) for i, f in enumerate(schema)]], names=["doc_id", *schema.names])

        for batch in batches:
            for part in slices(batch):
                values = []
                for s in shingle_sets(part.column("text"), width):
                    one, two, bands = _sketch(s)
                    found = None
                    if len(s) and (one, two) not in known:  # copies within a block are one set
                        known.add((one, two))
                        kept.append(s)
                        held += len(s)
                        if held >= BLOCK:
                            found = dense(kept)
                            kept, held, known = [], 0, set()
                    values.append((len(s), one, two, bands, found))
                yield rows(part.column("doc_id"), values)
        if found := dense(kept):
            null = pa.nulls(1, pa.int64())
            yield rows(null.cast(pa.string()) if kind == "string" else null.cast({"int": pa.int32()}.get(kind, pa.int64())), [(None, None, None, None, found)])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, s1 bigint, s2 bigint, bands array<bigint>, dense array<struct<token: bigint, count: bigint>>")


def leading(documents: DataFrame, dense: np.ndarray, num: int, den: int, width: int) -> DataFrame:
    """``s1, token``: the leading shingles of every set; those that pass the filter ``dense`` come last."""
    sent = documents.sparkSession.sparkContext.broadcast(dense)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        for batch in batches:
            for part in slices(batch):
                of, tokens, known = [], [], set()
                for s in shingle_sets(part.column("text"), width):
                    if not len(s):
                        continue
                    with np.errstate(over="ignore"):
                        one = mix(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64).view(np.int64)
                    if one in known:
                        continue
                    known.add(one)
                    n = len(s)
                    p = min(n, n - least_common(n, num, den) + spare(n))
                    is_dense = passes(common, s)
                    s = np.concatenate([s[~is_dense], s[is_dense]])[:p]
                    of.append(np.full(p, one, np.int64))
                    tokens.append(s)
                if of:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(of)), _signed(np.concatenate(tokens))], names=["s1", "token"])

    return documents.select("text").mapInArrow(run, "s1 bigint, token bigint")


def shared_only(rows: DataFrame, many: int = MANY) -> DataFrame:
    """Of (s1, token) rows those of tokens that two or more sets have, once each; ``dense`` if ``many`` have it.

    Rows are dealt and sorted by token, and runs are read as a stream: what is held
    is the batch and the rows of its last token, or one of them if that is dense.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = s = np.zeros(0, np.int64)
        told = False  # the first row is held of a dense token and was told
        for batch in chain(batches, [None]):
            if batch is not None:
                t, s = np.concatenate([t, batch.column("token").to_numpy()]), np.concatenate([s, batch.column("s1").to_numpy()])
            if not len(t):
                continue
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])
            t, s = t[new], s[new]
            start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            size = np.diff(np.append(start, len(t)))
            dense = size >= many
            dense[0] |= told
            out = np.repeat(dense | (size > 1), size)
            out[0] &= not told
            if batch is not None and not dense[-1]:  # its token may go on
                out[start[-1] :] = False
            yield pa.RecordBatch.from_arrays([pa.array(s[out]), pa.array(t[out]), pa.array(np.repeat(dense, size)[out])], names=["s1", "token", "dense"])
            told = bool(dense[-1])
            t, s = (t[-1:], s[-1:]) if told else (t[start[-1] :], s[start[-1] :])

    return rows.repartition("token").sortWithinPartitions("token", "s1").mapInArrow(run, "s1 bigint, token bigint, dense boolean")


def sets_of(documents: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``doc_id, tokens`` of the documents named in ``ids``, through a fixed-size filter, then exactly."""
    keyed = ids.select("doc_id").distinct().withColumn("h", F.xxhash64(F.col("doc_id")))
    sent = documents.sparkSession.sparkContext.broadcast(hash_filter(keyed, "h"))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            batch = batch.filter(pa.array(passes(bits, batch.column("h").to_numpy())))
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(shingle_sets(part.column("text"), width))], names=["doc_id", "tokens"])

    rows = documents.filter("doc_id is not null").select("doc_id", "text", F.xxhash64(F.col("doc_id")).alias("h")).mapInArrow(run, f"doc_id {kind}, tokens array<bigint>")
    return rows.join(keyed.select("doc_id"), "doc_id", "left_semi")


def linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of (a, b) pairs those whose sets link, exactly."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("a_tokens"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("b_tokens"))
    both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("a_tokens", "b_tokens")))
    return both.filter(den * F.col("common") >= num * (F.size("a_tokens") + F.size("b_tokens") - F.col("common"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) from edges (a, b).

    Each round takes the smallest label of the neighbours and then the label of that
    label; rounds grow with the logarithm of the longest path. Labels stay in tables.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("next"))
        after = saved(step.join(jump, "via", "left").select("node", "old", F.least("via", F.coalesce("next", "via")).alias("component")), "labels")
        moved = after.filter("old <> component").limit(1).count()
        labels = after.select("node", "component")
        if not moved:
            return labels


def _placed(df: DataFrame, part: DataFrame, node: str, name: str) -> DataFrame:
    """Adds the component of ``node``; what has no link is its own."""
    known = part.select(F.col("node").alias(node), F.col("component").alias(name))
    return df.join(known, node, "left").withColumn(name, F.coalesce(name, node))


def _side(df: DataFrame, p: str, key: list[str]) -> DataFrame:
    return df.select(*key, *[F.col(c).alias(f"{p}{c}") for c in df.columns if c not in key])


def _merged(part: DataFrame, links: DataFrame) -> DataFrame:
    return components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def stars(classes: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of a class and a head of one of its bands, and ``rep, g``: the group of each class that has a pair.

    The head of a band is the class that meets most classes in all its bands together.
    A class goes to the greatest of its heads, and with it to that one's own.
    """
    banded = classes.select("rep", "n", F.explode("bands").alias("band"))
    crowd = saved(banded.join(banded.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "band"), "bands")
    crowd = crowd.join(crowd.groupBy("rep").agg(F.sum("c").alias("met")), "rep")
    heads = crowd.groupBy("band").agg(F.max(F.struct("met", "rep", "n")).alias("head"))
    near = (F.col("head.n") * num <= F.col("n") * den) & (F.col("n") * num <= F.col("head.n") * den)
    pairs = saved(crowd.join(heads, "band").filter((F.col("rep") != F.col("head.rep")) & near).select("rep", "met", "head").distinct(), "stars")
    up = pairs.groupBy("rep").agg(F.max(F.struct("met", "rep")).alias("own"), F.max(F.struct("head.met", "head.rep")).alias("top")).select("rep", F.greatest("own", "top")["rep"].alias("g"))
    up = saved(up, "groups-of")
    far = up.join(up.select(F.col("rep").alias("g"), F.col("g").alias("g2")), "g", "left").select("rep", F.coalesce("g2", "g").alias("g"))
    return pairs.select(F.col("rep").alias("a"), F.col("head.rep").alias("b")), far


def apart_from_most(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``g, rep, n, k, odd, f``: members of groups in parts, by their difference from the shingles that most members have."""
    of_g = members.groupBy("g").agg(F.count(F.lit(1)).alias("members"), F.min("k").alias("low"), F.max("k").alias("high"))
    m = saved(members.join(of_g.filter("low <> high").select("g", "members"), "g").join(sets.withColumnRenamed("doc_id", "rep"), "rep"), "inside")
    most = m.select("g", "members", F.explode("tokens").alias("token")).groupBy("g", "members", "token").count().filter(2 * F.col("count") > F.col("members")).groupBy("g").agg(F.collect_list("token").alias("most"))
    known = F.coalesce("most", F.array().cast("array<bigint>"))
    apart = m.join(most, "g", "left").select("g", "rep", "n", "k", F.concat(F.array_except("tokens", known), F.array_except(known, "tokens")).alias("odd"))
    return apart.withColumn("f", F.size("odd") * (den + num) - F.col("n") * (den - num))


def rare_rows(cells: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of members at every rare shingle that both differ in: fewer than ``MANY`` a cell, however large the group."""
    met = _side(cells, "q_", ["g", "token"]).join(_side(cells, "m_", ["g", "token"]), ["g", "token"])
    sized = (F.col("q_n") * den >= F.col("m_n") * num) & (F.col("m_n") * den >= F.col("q_n") * num)
    return met.filter((F.col("q_rep") < F.col("m_rep")) & (F.col("q_k") != F.col("m_k")) & sized & (F.col("q_f") + F.col("m_f") > 0))


def dense_rows(kinds: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of kinds at shingles among the first ones of both, where what is left there can still reach the bound.

    A kind that shares c of its d shingles (rarest first) shares one of its first d - c + 1. The one of
    lesser f needs at least what two of its f need, the other at least what it needs with the least f of the group.
    """
    whole = 2 * (den + num)
    floor = kinds.groupBy("g").agg(F.min("f").alias("floor"))
    k = kinds.withColumn("d", F.size("common"))
    first = lambda over: F.col("d") - F.greatest(F.lit(1), F.ceil(over / whole)) + 1
    spread = lambda df, long: df.filter(long > 0).select("g", "kind", "f", "d", "low", "high", F.posexplode(F.slice("common", F.lit(1), long.cast("int"))).alias("at", "cell")).select("*", F.col("cell.token").alias("token")).drop("cell")
    less, more = spread(k, first(2 * F.col("f"))), spread(k.join(floor, "g"), first(F.col("f") + F.col("floor")))
    met = _side(less, "q_", ["g", "token"]).join(_side(more, "m_", ["g", "token"]), ["g", "token"])
    once = (F.col("q_f") < F.col("m_f")) | ((F.col("q_f") == F.col("m_f")) & (F.col("q_kind") < F.col("m_kind")))
    apart = (F.col("q_low") != F.col("m_low")) | (F.col("q_high") != F.col("m_high")) | (F.col("q_low") != F.col("q_high"))
    over = F.col("q_f") + F.col("m_f")
    left = F.least(F.col("q_d") - F.col("q_at"), F.col("m_d") - F.col("m_at"))
    return met.filter(once & apart & (over > 0) & (left * whole >= over)).select("g", "q_kind", "m_kind", over.alias("over"))


def inside(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that connect all linked ones of a group, and some that don't link.

    ``members`` has ``g, rep, n, k`` (the component). Two members with e and e' shingles of
    difference from what most of a group have, c of them in common, link if and only if
    2 c (den + num) is f + f' or more, where f = e (den + num) - n (den - num). Where f + f' is 0
    or less, both link with the member of the least f. Other links take a rare shingle
    (fewer than ``MANY`` members of the group differ in it), or frequent ones alone.

    Members of one f that differ in the same frequent shingles are of one kind, however
    many they are: of two kinds with enough of these in common all members link, so kinds are joined and not members.
    Each member then gets one partner of a kind that its own links with, and kinds their firsts.
    """
    whole = 2 * (den + num)
    apart = saved(apart_from_most(members, sets, num, den), "apart")
    least = apart.groupBy("g").agg(F.min(F.struct("f", "rep", "k")).alias("low"))
    auto = apart.join(least, "g").filter((F.col("k") != F.col("low.k")) & (F.col("f") + F.col("low.f") <= 0)).select(F.col("rep").alias("a"), F.col("low.rep").alias("b"))

    cells = apart.select("g", "rep", "n", "k", "f", F.explode("odd").alias("token"))
    counts = cells.groupBy("g", "token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")  # what one member alone has joins nothing
    cells = saved(cells.join(counts, ["g", "token"]), "odd-cells")
    common = cells.filter(F.col("c") >= MANY).groupBy("g", "rep", "k", "f").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("common"))
    common = saved(common, "frequent")

    rare = cells.filter(F.col("c") < MANY).drop("c").join(common.select("rep", F.size("common").alias("d")), "rep", "left").fillna(0, ["d"])
    met = rare_rows(rare, num, den).groupBy("q_rep", "m_rep").agg(F.count(F.lit(1)).alias("common"), F.first(F.ceil((F.col("q_f") + F.col("m_f")) / whole) - F.least("q_d", "m_d")).alias("needed"))
    by_rare = met.filter("common >= needed").select(F.col("q_rep").alias("a"), F.col("m_rep").alias("b"))

    key = ["g", "f", "common"]
    kinds = saved(common.groupBy(*key).agg(F.min("rep").alias("kind"), F.min("k").alias("low"), F.max("k").alias("high")), "kinds")
    pairs = dense_rows(kinds, num, den).distinct()
    for side in ("q", "m"):
        pairs = pairs.join(kinds.select(F.col("kind").alias(f"{side}_kind"), F.col("common").alias(f"{side}_common")), f"{side}_kind")
    pairs = pairs.filter(F.size(F.array_intersect("q_common", "m_common")) * whole >= F.col("over")).select(F.col("q_kind").alias("a"), F.col("m_kind").alias("b"))
    pairs = saved(pairs, "kind-pairs")
    itself = kinds.filter((F.col("low") != F.col("high")) & (F.col("f") > 0) & (F.size("common") * whole >= 2 * F.col("f"))).select(F.col("kind").alias("a"), F.col("kind").alias("b"))
    partner = pairs.union(pairs.select("b", "a")).union(itself).groupBy("a").agg(F.min("b").alias("b"))
    of_kind = common.join(kinds.filter("low <> high").select(*key, "kind"), key).join(partner.withColumnRenamed("a", "kind"), "kind")
    by_kind = of_kind.filter("rep <> b").select(F.col("rep").alias("a"), "b")
    return auto.unionByName(by_rare).unionByName(pairs).unionByName(by_kind).distinct()


def asked(cells: DataFrame, num: int, den: int) -> tuple[DataFrame, Column, Column]:
    """Rows (query, group, shingle) that can count, how many a query and group need in common, and how many dense ones they can have."""
    matrix = cells.groupBy("token", "gk").agg(*[F.first(c).alias(c) for c in ("g", "k", "members", "low", "high", "most")])
    # the smaller group asks the larger one; every pair of groups once
    order = (F.col("q_members") < F.col("m_members")) | ((F.col("q_members") == F.col("m_members")) & (F.col("q_gk") < F.col("m_gk")))
    sized = (F.col("q_n") * den >= F.col("m_low") * num) & (F.col("m_high") * den >= F.col("q_n") * num)
    # of members of sizes low to high one at either end needs least; between them rounding can take two off
    needed = F.least(least_leading(F.col("q_n"), F.col("m_low"), num, den), least_leading(F.col("q_n"), F.col("m_high"), num, den)) - F.when(F.col("m_low") == F.col("m_high"), 0).otherwise(2)
    common_dense = F.least("q_dl", "m_most")
    apart = (F.col("q_k") != F.col("m_k")) & (F.col("q_g") != F.col("m_g"))
    met = _side(cells.select("token", "rep", "n", "dl", "dense", "g", "k", "gk", "members"), "q_", ["token"]).join(_side(matrix, "m_", ["token"]), "token")
    return met.filter(apart & order & sized & (~F.col("q_dense") | (needed <= common_dense))), needed, common_dense


def jaccard_components(documents: DataFrame, num: int = NUM, den: int = DEN, width: int = WIDTH) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    ``num / den`` is the least ratio of common to all shingles. A text without words,
    or null, has no shingle and links with nothing. Rows with one ``doc_id`` are one
    node; a null id keeps its count, links with nothing and has a null component.
    Columns other than ``doc_id`` and ``text`` are ignored.
    """
    documents = documents.select("doc_id", "text")
    all_rows = saved(sketches(documents, width), "sketches")
    docs = all_rows.filter("n is not null").select("doc_id", "n", "s1", "s2", "bands")
    often = all_rows.filter("dense is not null").select(F.explode("dense").alias("d")).groupBy("d.token").agg(F.sum("d.count").alias("count")).filter(F.col("count") >= MANY)
    dense = hash_filter(often, "token")

    # classes of equal sets, and which of them one id joins
    named = docs.filter("doc_id is not null and n > 0")
    classes = saved(named.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    placed = saved(docs.join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "placed")
    of_id = placed.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("high"), F.min("n").alias("few")).filter("b <> high or few = 0")
    twins = saved(placed.join(of_id, "doc_id").filter("b is not null").select("doc_id", "rep", "b").distinct(), "twins")

    # 1. groups, and who links with a head
    pairs, group_of = stars(classes, num, den)
    star_ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    sets = saved(sets_of(documents, star_ids, width), "star-sets")
    part = components(saved(linked(pairs, sets, num, den).unionByName(twins.filter("rep <> b").select(F.col("rep").alias("a"), "b")), "star-links"))
    grouped = classes.select("rep", "n", "s1").join(group_of, "rep", "left").withColumn("g", F.coalesce("g", "rep"))

    # 2. inside a group
    near = saved(inside(_placed(grouped, part, "rep", "k").select("g", "rep", "n", "k"), sets, num, den), "near")
    part = _merged(part, saved(linked(near, sets, num, den), "near-links"))

    # 3. the matrix of leading shingles and connected members of a group, and the bound
    shared = saved(shared_only(leading(documents, dense, num, den, width)), "shared")
    own = shared.groupBy("s1").agg(F.count_if("dense").alias("dl"))
    grouped = saved(_placed(grouped, part, "rep", "k").join(own, "s1", "left").fillna(0, ["dl"]), "groups")
    bounds = grouped.groupBy("g", "k").agg(F.min("rep").alias("gk"), F.count(F.lit(1)).alias("members"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("dl").alias("most"))
    grouped = saved(grouped.join(bounds, ["g", "k"]), "bounded-groups")
    met, needed, common_dense = asked(saved(shared.join(grouped, "s1").drop("s1"), "cells"), num, den)
    cand = met.groupBy("q_rep", "q_n", "m_gk").agg(F.count(F.lit(1)).alias("common"), F.first(needed - F.when(needed > common_dense, common_dense).otherwise(0)).alias("needed"))
    cand = saved(cand.filter(F.col("common") >= F.col("needed")).select("q_rep", "q_n", "m_gk"), "opened")

    # 4. open groups that reach it: the head first, then, where that joined nothing, the others
    members = grouped.select(F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("gk").alias("m_gk"))
    heads_only = F.col("b") == F.col("m_gk")
    for which in (heads_only, ~heads_only):
        cand = _placed(_placed(cand, part, "q_rep", "q_k"), part, "m_gk", "m_k").filter("q_k <> m_k").select("q_rep", "q_n", "m_gk")
        pairs = cand.join(members.filter(which), "m_gk").filter((F.col("q_n") * den >= F.col("bn") * num) & (F.col("bn") * den >= F.col("q_n") * num))
        pairs = saved(pairs.select(F.col("q_rep").alias("a"), "b"), "pairs")
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
        more = ids.join(sets.select("doc_id"), "doc_id", "left_anti")
        sets = sets.unionByName(saved(sets_of(documents, more, width), "more-sets"))
        part = _merged(part, saved(linked(pairs, sets, num, den), "links"))

    # a row without words is its id's, whatever other rows have that
    empty = F.col("n") == 0
    others = placed.filter(empty).drop("rep").join(twins.select("doc_id", F.col("b").alias("rep")).distinct(), "doc_id", "left").select("doc_id", "n", "rep")
    placed = placed.filter(~empty).unionByName(others)
    return placed.join(part.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
