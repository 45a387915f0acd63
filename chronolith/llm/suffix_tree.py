"""Language-model scores from a probabilistic suffix tree over words (op10).

The tree's alphabet has the most frequent words, at most ``2**bits``, the end of a text,
its start (in contexts only), and one class for all other words, which are told apart by
their own frequency. A state of the tree is a context of up to ``depth`` symbols. A context
is kept if what follows it diverges enough from what its shorter suffix predicts: the
log-likelihood that it gains, with each occurrence judged by the others, has to reach
``GAIN``. Nothing else decides: what was seen once has no other occurrence that could judge
it, and gains nothing. A token is scored in the longest kept context before it, smoothed by
absolute discounting down to the root. What the root takes from all words is shared by as
many unknown words as get half of what a word seen once has, or all of it if that is less;
so an unknown word is always rarer than any known one in its place.

The alphabet bounds what is sent to all tasks and how many symbols can follow a context;
the tree itself grows with the corpus and is never held in one place. A run of depth + 1
symbols is one 64-bit number. Runs are counted in blocks, packed, and dealt by context to
buckets (a frequent context's by whole run); those seen twice or more come out as rows, and
the rest are joins and windows by context. A text's log-probability is a sum of one value
for each token and each run of it, so scoring looks up keys: the most frequent ones, of
which at most ``1 / HEAD_SHARE`` a length can be, in a broadcast, others in buckets of packed
keys, and only after contexts that are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, hash_filter, passes, saved
from .textarrays import give_back, hashed_by_eights, mix, slices, words_of

GAIN = 12.0
DISCOUNT = 0.75
#: symbols of the longest context; a run of depth + 1 symbols has 64 bits, so deeper trees have a smaller alphabet
DEPTH = 3
MOST_BITS = 16
#: codes: a word outside the alphabet, the start, the end, and the first word; 0 is none
RARE, START, STOP, FIRST = 1, 2, 3, 4
#: keys of so large a share of all tokens are sent to all tasks
HEAD_SHARE = 2e-6
#: tokens that are counted before a task sends them, and that a bucket is meant to get
BLOCK_TOKENS = 2_000_000
BUCKET_TOKENS = 500_000
#: rarer keys that a scoring task gathers before it asks, and bytes of text whose rarer keys a bucket answers
BLOCK_ASKS = 1_000_000
BUCKET_BYTES = 20 << 20
#: a context with so many occurrences (and a head's share) is dealt to all buckets
HOT_TOKENS = 250_000
#: stands behind each text's last word
END = np.uint64(0x656E64206F662074)
#: steps of counts in an octave, by which the alphabet is cut
STEPS = 16
#: keys whose buckets are told at once
PIECE = 1 << 17


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token, ends included, its row, and its place in the row."""
    w = words_of(texts, hashed=False)
    size = np.diff(w.first) + 1
    first = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    return np.insert(hashed_by_eights(w), w.first[1:], END), row, np.arange(len(row)) - first[row]


def _counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of n (or the count) of each."""
    order = None if n is None else np.argsort(keys)
    keys = np.sort(keys) if n is None else keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    at = np.flatnonzero(new)
    if n is None:
        return keys[at], np.diff(at, append=len(keys))
    return keys[at], np.add.reduceat(n[order], at) if len(at) else n


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _unsigned(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64).view(np.uint64)


def word_counts(documents: DataFrame) -> DataFrame:
    """``key, c``: occurrences of each word and of the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0

        def block() -> pa.RecordBatch:
            keys, n = _counted(np.concatenate(kept))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

        for batch in batches:
            for part in slices(batch):
                kept.append(tokens_of(part.column("text"))[0])
                held += len(kept[-1])
                if held >= BLOCK_TOKENS:
                    yield block()
                    kept, held = [], 0
        if kept:
            yield block()

    return documents.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("c"))


@dataclass
class Alphabet:
    bits: int
    keys: np.ndarray  # hashes in order
    codes: np.ndarray  # of each
    counts: np.ndarray  # tokens of each code; texts of the start

    def __post_init__(self) -> None:
        """Places by the low bits of a hash, a quarter of them taken at most; whoever finds its own taken goes to the next."""
        self.mask = np.uint64((1 << max(1, 4 * len(self.keys) - 1).bit_length()) - 1)
        self.placed, self.code_at = np.zeros(int(self.mask) + 1, np.uint64), np.zeros(int(self.mask) + 1, np.uint64)
        left = np.arange(len(self.keys))
        at = (self.keys & self.mask).astype(np.int64)
        while len(left):
            free = self.code_at[at] == 0
            self.code_at[at[free]] = self.codes[left[free]]  # of several that come at once the last one stays
            stays = self.code_at[at] == self.codes[left]
            self.placed[at[stays]] = self.keys[left[stays]]
            left, at = left[~stays], (at[~stays] + 1) & int(self.mask)

    def coded(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & self.mask).astype(np.int64)
        out = self.code_at[at]
        left = np.flatnonzero((self.placed[at] != hashes) & (out != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & int(self.mask)
            out[left] = code = self.code_at[at]
            on = (self.placed[at] != hashes[left]) & (code != 0)
            left, at = left[on], at[on]
        out[out == 0] = RARE
        return out


def alphabet(words: DataFrame, n: int, bits: int) -> Alphabet:
    """The end, and all words as frequent as the least frequent of the most frequent ones that fit.

    Words are cut by steps of their count, so that equally frequent ones are in or out together.
    """
    end = int(END.view(np.int64))
    step = F.floor(F.log2("c") * STEPS)
    sizes = words.filter(F.col("key") != end).groupBy(step.alias("step")).count().collect()  # some thousand at most
    room, least = (1 << bits) - FIRST, None
    for r in sorted(sizes, key=lambda r: -r["step"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    chosen = words.filter(F.col("key") == end).unionByName(words.filter((F.col("key") != end) & (step >= least)) if least is not None else words.limit(0)).toArrow()  # at most 2**bits
    keys, c = _unsigned(chosen, "key"), chosen.column("c").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    keys, c = keys[order], c[order]
    is_end = keys == END
    codes = np.where(is_end, STOP, FIRST + np.cumsum(~is_end) - 1).astype(np.uint64)
    counts = np.zeros(1 << bits, np.int64)
    counts[codes.astype(np.int64)] = c
    counts[RARE] = n - c.sum()
    counts[START] = counts[STOP]
    return Alphabet(bits, keys, codes, counts)


def runs_of(codes: np.ndarray, place: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``order`` symbols and the next, as numbers, and where their next symbol is.

    Before the first word stands one start.
    """
    at = np.flatnonzero(place >= order - 1)
    key = codes[at].copy()
    for j in range(1, order + 1):
        before = codes[np.maximum(at - j, 0)]
        key |= np.where(place[at] >= j, before, np.uint64(START)) << np.uint64(j * bits)
    return key, at


def _planes(keys: np.ndarray, n: int) -> list[np.ndarray]:
    """The keys as n arrays of 16 bits, high ones first: in order, high ones take next to no room when compressed."""
    return [(keys >> np.uint64(16 * j)).astype(np.uint16) for j in range(n - 1, -1, -1)]


def _joined(planes: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(planes[0]), np.uint64)
    for p in planes:
        out = (out << np.uint64(16)) | p.astype(np.uint64)
    return out


def _cut(a: np.ndarray, at: np.ndarray) -> pa.Array:
    """The bytes of ``a`` cut at places, the last one's end included."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * a.dtype.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(a))])


def _read(table: pa.Table, name: str, kind: type) -> np.ndarray:
    found = [np.frombuffer(x.as_buffer(), kind) for x in table.column(name) if x.is_valid]
    return np.concatenate(found) if found else np.zeros(0, kind)


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key, a piece at a time."""
    out = np.empty(len(x), np.uint16 if buckets <= 1 << 15 else np.int64)
    for lo in range(0, len(x), PIECE):
        out[lo : lo + PIECE] = (mix(x[lo : lo + PIECE].copy()) >> np.uint64(16)) % np.uint64(buckets)
    return out


def _dealt(keys: np.ndarray, shift: np.uint64, top: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each run's context, or of the run itself where its context is one of ``top``; a piece at a time."""
    out = np.empty(len(keys), np.uint16 if buckets <= 1 << 15 else np.int64)
    for lo in range(0, len(keys), PIECE):
        piece = keys[lo : lo + PIECE]
        context = piece >> shift
        out[lo : lo + PIECE] = _bucket(np.where(_found(top, context)[1], piece, context), buckets)
    return out


def successors(documents: DataFrame, names: Alphabet, order: int, hot: tuple[np.ndarray, np.ndarray], n_tokens: int) -> DataFrame:
    """``key, c, n``: runs of a context of ``order`` symbols and the next that are seen twice or more, and how often the context is.

    ``hot`` has frequent contexts, in order, and their counts.
    """
    sent = documents.sparkSession.sparkContext.broadcast((names, hot))  # at most 2**bits words and 1 / HEAD_SHARE contexts
    buckets = max(64, -(-n_tokens // BUCKET_TOKENS))
    shift = np.uint64(names.bits)
    n_planes = -(-(order + 1) * names.bits // 16)
    columns = [f"w{j}" for j in range(n_planes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (top, _) = sent.value
        kept, held = [], 0

        def block() -> pa.RecordBatch:
            """A row for each bucket: its runs, those seen more than once first, and these ones' counts."""
            together = np.concatenate(kept)
            kept.clear()
            keys, n = _counted(together)
            del together
            place = _dealt(keys, shift, top, buckets) * 2 + (n == 1)
            by = np.argsort(place, kind="stable")
            keys, n, place = keys[by], n[by].astype(np.int32), place[by]
            many = n > 1
            told = np.unique(place >> 1)
            at, at_many = np.append(np.searchsorted(place >> 1, told), len(place)), np.append(np.searchsorted(place[many] >> 1, told), int(many.sum()))
            return pa.RecordBatch.from_arrays([pa.array(told.astype(np.int64)), *(_cut(p, at) for p in _planes(keys, n_planes)), _cut(n[many], at_many)], names=["bucket", *columns, "counts"])

        for batch in batches:
            for part in slices(batch):
                h, _, place = tokens_of(part.column("text"))
                kept.append(runs_of(known.coded(h), place, order, known.bits)[0])
                held += len(kept[-1])
                if held >= BLOCK_TOKENS:
                    yield block()
                    held = 0
        if held:
            yield block()

    def count(table: pa.Table) -> pa.Table:
        keys = _joined([_read(table, c, np.uint16) for c in columns])
        n, at = np.ones(len(keys), np.int64), 0
        for size, counts in zip(pc.divide(pc.binary_length(table.column("w0")), 2).to_pylist(), table.column("counts"), strict=True):
            more = np.frombuffer(counts.as_buffer(), np.int32)
            n[at : at + len(more)] = more
            at += size
        keys, n = _counted(keys, n)
        context = keys >> shift
        start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        total = np.repeat(np.add.reduceat(n, start), np.diff(np.append(start, len(n))))
        top, counts = sent.value[1]
        at, there = _found(top, context)
        total[there] = counts[at[there]]
        twice = n > 1
        give_back()
        return pa.table({"key": keys[twice].view(np.int64), "c": n[twice], "n": total[twice]})

    rows = documents.select("text").mapInArrow(run, "bucket bigint, " + ", ".join(f"{c} binary" for c in [*columns, "counts"]))
    return rows.groupBy("bucket").applyInArrow(count, "key bigint, c bigint, n bigint")


def divergent(entries: DataFrame, bits: int, gain: float, discount: float = DISCOUNT) -> DataFrame:
    """``key, c, n, kept, p, over, log_rest`` of entries ``key, c, n, below``.

    ``below`` is what the shorter suffix predicts, ``p`` what a kept context does, or one
    that isn't hands on. A kept context's entry is ``over`` times (log10) as likely as by
    the rest alone that it leaves to its suffix; one entry of it tells that as ``log_rest``.
    """
    context = Window.partitionBy("context")  # a column of its own, so that all windows share one exchange and sort
    c, n = F.col("c"), F.col("n")
    e = entries.withColumn("context", F.shiftrightunsigned("key", bits)).withColumn("rest", 1 - F.sum(c - discount).over(context) / n)
    handed = F.col("rest") * F.col("below")
    others = (c - 1 - discount) / F.greatest(n - 1, F.lit(1)) + handed
    e = e.withColumn("won", F.sum(c * F.log(others / F.col("below"))).over(context) + (n - F.sum("c").over(context)) * F.log("rest"))
    e = e.withColumn("kept", F.col("won") >= gain).withColumn("one", F.min("key").over(context) == F.col("key"))
    own = (c - discount) / n + handed
    return e.select(
        "key", "c", "n", "kept", F.when(F.col("kept"), own).otherwise(F.col("below")).alias("p"),
        F.when(F.col("kept"), F.log10(own / handed)).alias("over"), F.when(F.col("kept") & F.col("one"), F.log10("rest")).alias("log_rest"),
    )


@dataclass
class Tree:
    """``levels``: a table of each length of contexts that are kept; ``words``: ``key, c``; ``log_root``: log10 probability of each code."""

    names: Alphabet
    words: DataFrame
    levels: list[DataFrame]
    log_root: np.ndarray
    tokens: int
    distinct: int
    lost: float  # what the root takes from each word's count

    def base(self, c):
        return np.log10((c + 1) / (self.tokens + self.distinct + 1))

    def of_rare(self, c: np.ndarray) -> np.ndarray:
        """log10 probability of words outside the alphabet among their like; c is 0 for unknown ones."""
        if not self.tokens:
            return np.zeros(len(c))
        of_class = 10 ** self.log_root[RARE] * self.tokens
        unknown = min(self.lost * self.distinct, (1 - self.lost) / 2)
        return np.log10(np.where(c > 0, np.maximum(c - self.lost, 1e-9), unknown) / of_class)

    def kept(self, order: int) -> int:
        """Contexts of a length that are kept."""
        return self.levels[order - 1].filter("log_rest is not null").count()


def fit(documents: DataFrame, gain: float = GAIN, depth: int = DEPTH, most_bits: int = MOST_BITS, hot_tokens: int = HOT_TOKENS) -> Tree:
    """The tree of all ``text`` of ``documents``; a null text counts as empty, and has one token, its end.

    Contexts have at most ``depth`` symbols; the alphabet has at most ``2**most_bits``, and
    as many as depth + 1 of them fit into 64 bits.
    """
    documents = documents.select("text")
    words = saved(word_counts(documents), "words")
    n, v, once, twice = (int(x or 0) for x in words.agg(F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first())
    lost = min(0.9, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
    bits = min(most_bits, 64 // (depth + 1))
    names = alphabet(words, n, bits)
    mass = names.counts - np.where(names.counts > 0, lost, 0.0)
    mass[[0, START]] = 0
    mass[RARE] = n - (mass.sum() - mass[RARE])
    root = mass / max(n, 1)
    used = np.flatnonzero(root > 0)
    below = documents.sparkSession.createDataFrame(pd.DataFrame({"symbol": used.astype(np.int64), "below": root[used]}), "symbol bigint, below double")

    levels: list[DataFrame] = []
    hot_from = max(hot_tokens, int(HEAD_SHARE * n))
    hot = (np.flatnonzero(names.counts >= hot_from).astype(np.uint64), names.counts[names.counts >= hot_from])
    for order in range(1, depth + 1):
        pairs = saved(successors(documents, names, order, hot, n), "runs")
        tail = F.col("key").bitwiseAND(F.lit((1 << (order * bits)) - 1))
        shorter = F.broadcast(below) if order == 1 else levels[-1].select(F.col("key").alias("symbol"), F.col("p").alias("below"))  # at most 2**bits rows
        level = divergent(pairs.join(shorter, tail == F.col("symbol")).drop("symbol"), bits, gain)
        # what isn't kept is only needed for the next length
        levels.append(saved(level if order < depth else level.filter("kept").drop("p"), "tree-level"))
        whole = levels[-2:-1]
        levels[-2:-1] = [saved(x.filter("kept").drop("p"), "tree-level") for x in whole]
        top = pairs.filter(F.col("c") >= hot_from).select("key", "c").toArrow()  # at most 1 / HEAD_SHARE
        order_of = np.argsort(_unsigned(top, "key"))
        hot = _unsigned(top, "key")[order_of], top.column("c").to_numpy().astype(np.int64)[order_of]
        discard(pairs, *whole)
    with np.errstate(divide="ignore"):
        return Tree(names, words, levels, np.where(root > 0, np.log10(root), 0.0), n, v, lost)


def _mixed(df: DataFrame, key: Column) -> DataFrame:
    """``h``: the keys, spread over all bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column(0).to_numpy().view(np.uint64).copy()).view(np.int64))], names=["h"])

    return df.select(key.alias("key")).mapInArrow(run, "h bigint")


def _asked(rows: np.ndarray, keys: np.ndarray, first: int, buckets: int) -> tuple[np.ndarray, list[pa.Array], int]:
    """For each bucket which row asks for which key: buckets from ``first`` on, packed rows and keys, the row from which rows count."""
    bucket = _bucket(keys, buckets)
    by = np.argsort(keys)  # packs better
    by = by[np.argsort(bucket[by], kind="stable")]
    told = np.unique(bucket)
    at = np.append(np.searchsorted(bucket[by], told), len(by))
    base = int(rows.min())
    near = (rows[by] - base).astype(np.uint64)
    return told.astype(np.int64) + first, [_cut(p, at) for p in (*_planes(near, 2), *_planes(keys[by], 4))], base


_ASK = ["r0", "r1", "k0", "k1", "k2", "k3"]


def score(documents: DataFrame, tree: Tree, head_share: float = HEAD_SHARE) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, n_known, base_score, score``.

    A null or empty text has one token, its end. With nothing learned, every text has
    log-probability 0. Columns other than ``doc_id`` and ``text`` are ignored; repeated
    rows and null ids give rows of their own.
    """
    spark = documents.sparkSession
    bits, depth = tree.names.bits, len(tree.levels)
    context = F.shiftrightunsigned("key", bits)
    entries = [level.filter("kept").select("key", "c", F.col("over").alias("value")) for level in tree.levels]
    rests = [level.filter("log_rest is not null").select(context.alias("key"), F.col("n").alias("c"), F.col("log_rest").alias("value")) for level in tree.levels]
    one = rests[0].toArrow()  # at most 2**bits
    rest_of = np.zeros(1 << bits)
    rest_of[one.column("key").to_numpy().astype(np.int64)] = one.column("value").to_numpy()
    values = entries[0]
    for more in entries[1:] + rests[1:]:
        values = values.unionByName(more)
    in_head = F.col("c") >= max(2, head_share * tree.tokens)
    top = values.filter(in_head).select("key", "value").toArrow()  # at most 2 / head_share a length
    head = _counted(_unsigned(top, "key"), top.column("value").to_numpy().astype(float)) if top.num_rows else (np.zeros(0, np.uint64), np.zeros(0))
    has_entry = [hash_filter(_mixed(e, F.col("key")), "h") for e in entries]
    has_rest = [None, *(hash_filter(_mixed(r, F.col("key")), "h") for r in rests[1:])]
    alone = np.stack([tree.base(tree.names.counts), tree.log_root]) if tree.tokens else np.zeros((2, 1 << bits))
    sent = spark.sparkContext.broadcast((tree.names, alone, rest_of, head, has_entry, has_rest))  # all of bounded size
    id_kind = documents.schema["doc_id"].dataType.simpleString()
    n_bytes = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    run_buckets = max(12, -(-n_bytes // BUCKET_BYTES))
    word_buckets = max(12, run_buckets // 4)
    learned = tree.tokens > 0
    schema = f"doc_id {id_kind}, bucket bigint, base_row bigint, n_tokens bigint, known bigint, base double, value double, " + ", ".join(f"{c} binary" for c in _ASK)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, (base_of, root_of), rest_1, (top_keys, top_values), entry_bits, rest_bits = sent.value
        next_row = TaskContext.get().partitionId() << 40
        kept: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}
        id_type, held = None, 0

        def asking() -> Iterator[pa.RecordBatch]:
            for is_word, got in kept.items():
                rows, keys = (np.concatenate([g[i] for g in got]) for i in (0, 1)) if got else (np.zeros(0), np.zeros(0))
                got.clear()
                if len(rows):
                    buckets, packed, base_row = _asked(rows, keys, 0 if is_word else word_buckets, word_buckets if is_word else run_buckets)
                    n = len(buckets)
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, id_type), pa.array(buckets), pa.array(np.full(n, base_row)), *(pa.nulls(n, k) for k in kinds[2:]), *packed], names=["doc_id", "bucket", "base_row", "n_tokens", "known", "base", "value", *_ASK])

        for batch in batches:
            for part in slices(batch):
                id_type, n_rows = part.column("doc_id").type, part.num_rows
                h, row, place = tokens_of(part.column("text"))
                codes = names.coded(h)
                at = codes.astype(np.int64)
                rare = at == RARE
                of_row = lambda x, where=slice(None): np.bincount(row[where], x, n_rows)  # noqa: B023, E731
                base, value, known = of_row(np.where(rare, 0, base_of[at])), of_row(root_of[at]), of_row((~rare).astype(float))
                kept[True].append((next_row + row[rare], h[rare]))
                before = np.where(place > 0, at[np.maximum(np.arange(len(at)) - 1, 0)], START)
                value += of_row(rest_1[before])
                held += int(rare.sum())
                follows = rest_1[before] != 0  # where a context of the last length is kept
                use = np.arange(len(at))
                for order in range(1, depth + 1):
                    key, where = runs_of(codes, place, order, names.bits)
                    spread = mix(key.copy())
                    own = np.zeros(len(at), bool)
                    own[use] = follows
                    may = own[where] & passes(entry_bits[order - 1], spread)
                    if order < depth:
                        more = passes(rest_bits[order], spread)
                        may |= more
                    ask = np.flatnonzero(may)  # the head's keys pass the filters too
                    at_top, there = _found(top_keys, key[ask])
                    value += of_row(top_values[at_top[there]], where[ask[there]]) if len(top_keys) else 0
                    ask = ask[~there]
                    kept[False].append((next_row + row[where[ask]], key[ask]))
                    held += len(ask)
                    if order < depth:
                        # the context of the next length ends one token before
                        full = np.zeros(len(at) + 1, bool)
                        full[where + 1] = more
                        use, follows = np.flatnonzero(place >= order), full[:-1][place >= order]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(-1 - (np.arange(next_row, next_row + n_rows) >> 12)), pa.array(np.arange(next_row, next_row + n_rows)), pa.array(np.bincount(row, minlength=n_rows).astype(np.int64)), pa.array(known.astype(np.int64) * learned), pa.array(base * learned), pa.array(value * learned), *(pa.nulls(n_rows, pa.binary()) for _ in _ASK)],
                    names=["doc_id", "bucket", "base_row", "n_tokens", "known", "base", "value", *_ASK],
                )
                next_row += n_rows
                if held >= BLOCK_ASKS:
                    yield from asking()
                    held = 0
        if held:
            yield from asking()

    bare = replace(tree, words=None, levels=[])  # tables stay with the driver

    def answer(asks: pa.Table, told: pa.Table) -> pa.Table:
        """Sums of what a bucket's keys add to the rows that ask for them; rows of texts pass."""
        plain = ["doc_id", "base_row", "n_tokens", "known", "base", "value"]
        if not asks.num_rows or asks.column("bucket")[0].as_py() < 0:
            n = asks.num_rows
            return asks.select(plain).append_column("rows", pa.nulls(n, pa.binary())).append_column("adds", pa.nulls(n, pa.binary()))
        is_word = asks.column("bucket")[0].as_py() < word_buckets
        key, value = _counted(_unsigned(told, "key"), told.column("value").to_numpy().astype(float)) if told.num_rows else (np.zeros(0, np.uint64), np.zeros(0))
        rows, sums = [], []
        for packed in zip(*(asks.column(c) for c in _ASK), strict=True):
            planes = [np.frombuffer(x.as_buffer(), np.uint16) for x in packed]
            distinct, inverse = np.unique(_joined(planes[:2]), return_inverse=True)
            at, there = _found(key, _joined(planes[2:]))
            got = np.zeros(len(inverse))
            got[there] = value[at[there]]
            adds = ((got > 0).astype(float), bare.base(got), bare.of_rare(got)) if is_word else (got,)
            rows.append(distinct.astype(np.uint32).tobytes())
            sums.append(np.stack([np.bincount(inverse, x, len(distinct)) for x in adds]).tobytes())
        give_back()
        n = asks.num_rows
        empty = [asks.column("doc_id"), asks.column("base_row"), *(pa.nulls(n, k) for k in kinds[2:])]
        return pa.Table.from_arrays([*empty, pa.array(rows, pa.binary()), pa.array(sums, pa.binary())], names=[*plain, "rows", "adds"])

    def together(answers: pa.Table) -> pa.Table:
        """Sums over the buckets that rows from one ``base_row`` on asked."""
        rows = [np.frombuffer(x.as_buffer(), np.uint32) for x in answers.column("rows")]
        adds = []
        for r, x in zip(rows, answers.column("adds"), strict=True):
            a = np.frombuffer(x.as_buffer(), np.float64).reshape(-1, len(r))
            adds.append(a if len(a) == 3 else np.concatenate([np.zeros((2, len(r))), a]))
        distinct, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        known, base, value = (np.bincount(inverse, x, len(distinct)) for x in np.concatenate(adds, axis=1))
        return pa.table({"row": distinct.astype(np.int64) + answers.column("base_row")[0].as_py(), "more_known": known.astype(np.int64), "more_base": base, "more_value": value})

    rare = tree.words.join(F.broadcast(spark.createDataFrame(pd.DataFrame({"key": tree.names.keys.view(np.int64)}), "key bigint")), "key", "left_anti")  # at most 2**bits
    spots = _bucketed(rare.select("key", F.col("c").cast("double").alias("value")), 0, word_buckets).unionByName(_bucketed(values.filter(~in_head), word_buckets, run_buckets))
    asks = documents.select("doc_id", "text").mapInArrow(run, schema)
    met = asks.groupBy("bucket").cogroup(spots.groupBy("bucket")).applyInArrow(answer, f"doc_id {id_kind}, base_row bigint, n_tokens bigint, known bigint, base double, value double, rows binary, adds binary")
    met = saved(met, "lm-answers")
    summed = met.filter("rows is not null").groupBy("base_row").applyInArrow(together, "row bigint, more_known bigint, more_base double, more_value double")
    more = summed.groupBy("row").agg(*[F.sum(x).alias(x) for x in ("more_known", "more_base", "more_value")])
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    rows = met.filter("rows is null").select("doc_id", F.col("base_row").alias("row"), "n_tokens", "known", "base", "value")
    out = rows.join(more, "row", "left") if learned else rows.withColumns({x: F.lit(0) for x in ("more_known", "more_base", "more_value")})
    return out.select("doc_id", "n_tokens", plus("known", "more_known").alias("n_known"), plus("base", "more_base").alias("base_score"), plus("value", "more_value").alias("score"))


def _bucketed(df: DataFrame, first: int, buckets: int) -> DataFrame:
    """``bucket, key, value``, dealt as asking rows deal their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(keys, buckets).astype(np.int64) + first), batch.column("key"), batch.column("value")], names=["bucket", "key", "value"])

    return df.select("key", "value").mapInArrow(run, "bucket bigint, key bigint, value double")
