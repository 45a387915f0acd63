"""Quality rules learned by gradient-boosted trees over document statistics (op7).

Trees are grown here on a bounded labelled sample, with histogram splits and monotonic
constraints, and flattened into arrays of node feature, threshold, children and value.
Scoring walks all texts of a batch down a tree at once. Statistics are exact counts over
whole texts; the plain rules (too few words, too many repeated ones) come beside them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import GRAM_KEYS, HEADS, PIECE_BYTES, SAME, SPACED, buffer, grams, mix, slices, words_of

TREES = 60
DEPTH = 3
RATE = 0.2
BINS = 64
MIN_WORDS = 50
REPEAT_NUM, REPEAT_DEN = 50, 100

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "word_len", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "digit_share", "stop_share", "short_share", "lines", "distinct_share")
#: features that may only lower the score (-1) or raise it (+1)
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "bang_share": -1, "upper_share": -1, "distinct_share": 1}

_BYTES = np.arange(256)
_SYMBOLS = np.isin(_BYTES, list(b"#*$%&|<>"))
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_STOP = np.isin(_BYTES, list(b".,;:?"))


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[off[1:]] - sums[off[:-1]]


def _repeated(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether its row has it twice or more, and whether it had it before."""
    own = mix(key ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    s = own[order]
    same = s[1:] == s[:-1] if len(s) else np.zeros(0, bool)
    twice, later = np.zeros(len(s), bool), np.zeros(len(s), bool)
    if len(s):
        twice[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        later[order] = np.concatenate([[False], same])
    return twice, later


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """STATS (exact integers) and FEATURES of each text."""
    raw, off = buffer(texts)
    n_rows = len(off) - 1
    w = words_of(texts, case=SAME)
    n_words = np.diff(w.first)
    heads = HEADS[raw]
    word_chars = _per_row(heads & SPACED[raw], off)
    symbols = _per_row(_SYMBOLS[raw], off)

    # lines: the whole string between line feeds, white space included
    feeds = np.flatnonzero(raw == 10)
    lo = np.concatenate([off[:-1], feeds + 1])
    line_row = np.concatenate([np.arange(n_rows), np.searchsorted(off, feeds, side="right") - 1])
    pairs = np.lexsort((lo, line_row))  # a feed that ends a text opens a last line where the next text begins
    lo, line_row = lo[pairs], line_row[pairs]
    hi = np.concatenate([lo[1:] - 1, [len(raw)]]) if len(lo) else lo
    last = np.concatenate([line_row[1:] != line_row[:-1], [True]]) if len(lo) else np.zeros(0, bool)
    hi[last] = off[line_row[last] + 1]
    first_word = np.searchsorted(w.start, lo)
    has_word = np.searchsorted(w.start, hi) > first_word
    lo, hi, line_row = lo[has_word], hi[has_word], line_row[has_word]
    dup_lines = np.zeros(n_rows, np.int64)
    if len(lo):
        _, later = _repeated(line_row, _range_hash(raw, lo, hi))
        dup_lines = np.bincount(line_row[later], minlength=n_rows)
    n_lines = np.bincount(line_row, minlength=n_rows)

    repeat = np.zeros(n_rows, np.int64)
    g, inside = grams(w.hash, w.row, 3)
    if len(g):
        twice = np.zeros(len(g), bool)
        at = np.flatnonzero(inside)
        twice[at] = _repeated(w.row[at], g[at])[0]
        cover = np.zeros(len(w.row), bool)
        for j in range(3):
            cover[j : j + len(g)] |= twice
        repeat = np.bincount(w.row[cover], minlength=n_rows)
    _, again = _repeated(w.row, w.hash)
    distinct = n_words - np.bincount(w.row[again], minlength=n_rows)
    short = np.bincount(w.row[(w.end - w.start) <= 2], minlength=n_rows)

    size, words, lines = np.maximum(np.diff(off), 1), np.maximum(n_words, 1), np.maximum(n_lines, 1)
    stats = np.stack([n_words, word_chars, symbols, dup_lines, repeat], axis=1).astype(np.int64)
    features = np.stack([
        np.log1p(n_words), word_chars / words, symbols / size, dup_lines / lines, repeat / words, _per_row(_UPPER[raw], off) / size, _per_row(raw == 33, off) / size,
        _per_row(_DIGIT[raw], off) / size, _per_row(_STOP[raw], off) / size, short / words, np.log1p(n_lines), distinct / words,
    ], axis=1)
    return stats, features


def _range_hash(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each range [lo, hi), which are in order and apart; bytes are hashed in pieces."""
    total = np.zeros(len(lo), np.uint64)
    at = 0
    while at < len(lo):
        # as many ranges as fit into a piece, or one range in pieces
        to = max(at + 1, int(np.searchsorted(hi, lo[at] + PIECE_BYTES, side="right")))
        for a in range(int(lo[at]), int(hi[to - 1]), PIECE_BYTES) if to == at + 1 else [int(lo[at])]:
            b = min(int(hi[to - 1]), a + PIECE_BYTES) if to == at + 1 else int(hi[to - 1])
            own_lo, own_hi = np.maximum(lo[at:to], a), np.minimum(hi[at:to], b)
            place = np.arange(a, b, dtype=np.int64) - np.repeat(lo[at:to], np.diff(np.append(own_lo, b)))
            key = (raw[a:b].astype(np.uint64) + np.uint64(1)) * GRAM_KEYS[place & 63]
            key += key * (place >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(key), dtype=np.uint64)])
            total[at:to] += sums[own_hi - a] - sums[own_lo - a]
        at = to
    return mix(total ^ (hi - lo).astype(np.uint64))


@dataclass
class Forest:
    """Trees one after another: node arrays, the root of each tree, and the score they start from."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                f = self.feature[node]
                down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(f >= 0, down, node)
            out += self.value[node]
        return out


def grow(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], trees: int = TREES, depth: int = DEPTH, rate: float = RATE, smooth: float = 1.0) -> Forest:
    """Boosts log-loss; a split that breaks a feature's direction is not taken, and below
    one that keeps it both sides' values are held apart at their middle."""
    share = np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98)
    start = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots = []
    if len(y) and y.min() < y.max():
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        f = np.full(len(y), start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            roots.append(_grow_node(nodes, bins, cuts, g, h, np.arange(len(y)), depth, rate, smooth, monotone, -np.inf, np.inf, f))
    a = np.array(nodes, np.float64).reshape(-1, 5)
    return Forest(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots, np.int64), start)


def _grow_node(nodes, bins, cuts, g, h, rows, depth, rate, smooth, monotone, low, high, f) -> int:
    me = len(nodes)
    gs, hs = g[rows].sum(), h[rows].sum()
    value = float(np.clip(-gs / (hs + smooth), low, high))
    nodes.append([-1, 0.0, 0, 0, rate * value])
    best = (1e-3, -1, 0, 0.0, 0.0)
    if depth and len(rows) >= 20:
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            hg = np.cumsum(np.bincount(bins[rows, j], g[rows], len(c) + 1))[:-1]
            hh = np.cumsum(np.bincount(bins[rows, j], h[rows], len(c) + 1))[:-1]
            n = np.cumsum(np.bincount(bins[rows, j], minlength=len(c) + 1))[:-1]
            lv, rv = np.clip(-hg / (hh + smooth), low, high), np.clip(-(gs - hg) / (hs - hh + smooth), low, high)
            gain = hg**2 / (hh + smooth) + (gs - hg) ** 2 / (hs - hh + smooth) - gs**2 / (hs + smooth)
            gain[(n < 5) | (len(rows) - n < 5)] = -1
            if monotone.get(j):
                gain[monotone[j] * (rv - lv) < 0] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(lv[k]), float(rv[k]))
    _, j, k, lv, rv = best
    if j < 0:
        f[rows] += rate * value
        return me
    lo_l, hi_l, lo_r, hi_r = low, high, low, high
    if monotone.get(j):
        mid = (lv + rv) / 2
        (lo_l, hi_l, lo_r, hi_r) = (low, mid, mid, high) if monotone[j] > 0 else (mid, high, low, mid)
    go_left = bins[rows, j] <= k
    left = _grow_node(nodes, bins, cuts, g, h, rows[go_left], depth - 1, rate, smooth, monotone, lo_l, hi_l, f)
    right = _grow_node(nodes, bins, cuts, g, h, rows[~go_left], depth - 1, rate, smooth, monotone, lo_r, hi_r, f)
    nodes[me] = [j, float(cuts[j][k]), left, right, 0.0]
    return me


def fit(texts: list[str], labels: list[int], good_share: float = 0.5) -> Forest:
    y = np.array(labels, np.float64)
    x = statistics(pa.array(texts, pa.string()))[1] if texts else np.zeros((0, len(FEATURES)))
    forest = grow(x, y, {FEATURES.index(k): v for k, v in MONOTONE.items()})
    if len(y):
        seen, meant = np.clip([y.mean(), good_share], 0.02, 0.98)
        forest.start += float(np.log(meant / (1 - meant)) - np.log(seen / (1 - seen)))
    return forest


def apply_rules(documents: DataFrame, forest: Forest) -> DataFrame:
    """One row per input row: ``doc_id``, STATS, ``base_failed, score, kept``.

    A null text counts as empty: no words, and so failed. Words, lines and three-word
    windows are compared by 64-bit hashes. Without labels, all that pass the base rules
    are scored alike. Columns other than ``doc_id`` and ``text`` are ignored.
    """
    sent = documents.sparkSession.sparkContext.broadcast(forest)  # TREES * 2**(DEPTH + 1) nodes at most
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                stats, features = statistics(part.column("text"))
                score = 1 / (1 + np.exp(-sent.value.raw_score(features)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(stats[:, j]) for j in range(len(STATS))], pa.array(score)], names=["doc_id", *STATS, "score"])

    rows = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{s} bigint" for s in STATS) + ", score double")
    failed = (F.col("n_words") < MIN_WORDS) | (REPEAT_DEN * F.col("n_repeat_words") > REPEAT_NUM * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= 0.5))
