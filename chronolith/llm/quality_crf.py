"""Document quality from line labels of a linear-chain conditional random field (op1).

Every line of a text is a node with two states, bad and good. Its features are
statistics of the line and of the lines before and after it, so that junk in between
good lines is told from a short line in good company. Forward-backward gives each
line's marginal; means of it, weighted by line length, feed a logistic curve that
gives the document's score.

Training takes a bounded sample of labelled documents; each line takes its document's
label, and weights follow the gradient of the chain's log-likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import sample_keys, sample_rows, saved
from .textarrays import GRAM_KEYS, buffer, mix, slices, words_of

#: bounds of the training sample: documents and bytes of each label
SAMPLE_DOCS = 1500
SAMPLE_BYTES = 6 << 20
EPOCHS = 120

_BYTES = np.arange(256)
_CLASSES = [
    ("upper", (_BYTES >= 65) & (_BYTES <= 90)),
    ("lower", (_BYTES >= 97) & (_BYTES <= 122)),
    ("digit", (_BYTES >= 48) & (_BYTES <= 57)),
    ("high", _BYTES >= 128),
    ("stop", np.isin(_BYTES, list(b".,;:?'\"-()"))),
    ("bang", _BYTES == 33),
    ("bar", _BYTES == 124),
    ("sign", np.isin(_BYTES, list(b"#$%&*<>=+@/\\^_`~[]{}"))),
]


@dataclass
class Lines:
    """Features of each line (rows), its weight, and of each text its first line, with the end last."""

    features: np.ndarray
    weight: np.ndarray
    first: np.ndarray


def _same_as_earlier(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    own = mix(key ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    again = np.zeros(len(own), bool)
    again[order[1:]] = own[order[1:]] == own[order[:-1]]
    return again


def line_features(texts: pa.Array) -> Lines:
    """Lines with a word of each text; a text without any has none."""
    raw, off = buffer(texts)
    w = words_of(texts, case=np.arange(256, dtype=np.uint8))
    n_rows = len(off) - 1
    if not len(w.start):
        return Lines(np.zeros((0, N_FEATURES), np.float32), np.zeros(0), np.zeros(n_rows + 1, np.int64))
    breaks = np.flatnonzero(raw == 10)
    line_of = np.searchsorted(breaks, w.start)
    new = np.concatenate([[True], (line_of[1:] != line_of[:-1]) | (w.row[1:] != w.row[:-1])])
    at = np.flatnonzero(new)  # first word of each line that has one
    row = w.row[at]
    n_words = np.diff(np.concatenate([at, [len(w.start)]]))
    lo, hi = w.start[at], w.end[np.concatenate([at[1:], [len(w.start)]]) - 1]
    n = np.maximum(hi - lo, 1).astype(np.float64)

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(mask[raw].astype(np.int32), lo)  # up to the next line: what lies between is white space
        return sums.astype(np.float64)

    share = {name: count(mask) / n for name, mask in _CLASSES}
    length = (w.end - w.start).astype(np.float64)
    mean_len = np.add.reduceat(length, at) / n_words
    again = np.add.reduceat(np.concatenate([[0.0], ((w.hash[1:] == w.hash[:-1]) & ~new[1:]).astype(np.float64)]), at) / n_words
    alone = np.add.reduceat((length == 1).astype(np.float64), at) / n_words
    caps = np.zeros(len(w.start))
    caps[:] = (raw[w.start] >= 65) & (raw[w.start] <= 90)
    caps = np.add.reduceat(caps, at) / n_words
    place = np.arange(len(w.start)) - np.repeat(at, n_words)
    key = mix(np.add.reduceat(w.hash * GRAM_KEYS[place & 63], at))
    dup = _same_as_earlier(row, key).astype(np.float64)
    distinct_words = 1 - np.add.reduceat(_same_as_earlier(np.repeat(np.arange(len(at)), n_words), w.hash).astype(np.float64), at) / n_words
    own = np.stack(
        [*share.values(), np.minimum(mean_len, 30) / 10, again, alone, caps, dup, distinct_words, np.minimum(np.log1p(n_words), 6) / 3, (n_words <= 2).astype(float),
         share["upper"] > 0.5, share["sign"] > 0.05, share["bar"] > 0.01, share["bang"] > 0.02], axis=1,
    ).astype(np.float32)
    edge_first = np.concatenate([[True], row[1:] != row[:-1]])
    edge_last = np.concatenate([row[1:] != row[:-1], [True]])
    before = np.concatenate([np.zeros((1, own.shape[1]), np.float32), own[:-1]])
    after = np.concatenate([own[1:], np.zeros((1, own.shape[1]), np.float32)])
    before[edge_first] = own[edge_first]
    after[edge_last] = own[edge_last]
    one = np.ones((len(own), 1), np.float32)
    out = np.concatenate([own, before, after, edge_first[:, None].astype(np.float32), edge_last[:, None].astype(np.float32), one], axis=1)
    return Lines(out, n, np.searchsorted(row, np.arange(n_rows + 1)))


N_OWN = len(_CLASSES) + 12
N_FEATURES = 3 * N_OWN + 3


def _by_step(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Texts by falling number of lines, their first lines, and how many reach each step."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    return first[:-1][order], count[order], [int(x) for x in np.searchsorted(-count[order], -np.arange(1, (count.max() if len(count) else 0) + 1), side="right")]


def marginals(gain: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, the expected transitions, and the sum of log Z.

    ``gain`` is the score of good over bad; ``moves[i, j]`` of going from state i to j.
    All texts take step t at once, so that the loop is as long as the longest text.
    """
    n = len(gain)
    begin, _, reach = _by_step(first)
    emit = np.stack([np.zeros(n), gain], axis=1)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    m00, m01, m10, m11 = moves.ravel()
    for t, k in enumerate(reach):
        i = begin[:k] + t
        if t == 0:
            a[i] = emit[i]
        else:
            p = a[i - 1]
            a[i, 0] = emit[i, 0] + np.logaddexp(p[:, 0] + m00, p[:, 1] + m10)
            a[i, 1] = emit[i, 1] + np.logaddexp(p[:, 0] + m01, p[:, 1] + m11)
    for t in range(len(reach) - 2, -1, -1):
        i = begin[: reach[t + 1]] + t
        q = b[i + 1] + emit[i + 1]
        b[i, 0] = np.logaddexp(m00 + q[:, 0], m01 + q[:, 1])
        b[i, 1] = np.logaddexp(m10 + q[:, 0], m11 + q[:, 1])
    z = np.logaddexp(a[:, 0] + b[:, 0], a[:, 1] + b[:, 1])
    good = np.exp(a[:, 1] + b[:, 1] - z)
    inner = np.ones(n, bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    i = np.flatnonzero(inner)
    expected = np.array([[np.exp(a[i - 1, s] + moves[s, u] + emit[i, u] + b[i, u] - z[i]).sum() for u in (0, 1)] for s in (0, 1)])
    return good, expected, float(z[first[:-1][np.diff(first) > 0]].sum())


@dataclass
class Model:
    weights: np.ndarray
    moves: np.ndarray
    curve: np.ndarray  # of the logistic over summary()


def summary(good: np.ndarray, lines: Lines) -> np.ndarray:
    """Of each text: logit of the length-weighted mean, its bad share, the share of lines surely bad, one."""
    n = len(lines.first) - 1
    row = np.repeat(np.arange(n), np.diff(lines.first))
    total = np.maximum(np.bincount(row, lines.weight, n), 1)
    mean = np.where(np.diff(lines.first) > 0, np.bincount(row, lines.weight * good, n) / total, 0.0)
    sure = np.bincount(row, lines.weight * (good < 0.5), n) / total
    clipped = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.stack([np.log(clipped / (1 - clipped)), 1 - mean, sure, np.ones(n)], axis=1)


def _adam(params: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        g = gradient(params)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return params


def fit(texts: list[str], labels: list[int], good_share: float = 0.5, epochs: int = EPOCHS) -> Model:
    """Both labels weigh the same in the chain; without one of them every text gets the other's score.

    ``good_share`` is the share of label 1 where the sample came from; the curve is shifted to it.
    """
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), np.array([0.0, 0.0, 0.0, 4.0 if len(y) and y[0] == 1 else (-4.0 if len(y) else 0.0)]))
    lines = line_features(pa.array(texts, pa.string()))
    per = np.diff(lines.first)
    state = np.repeat(y, per)
    share = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    inner = np.ones(len(state), bool)
    inner[lines.first[:-1][per > 0]] = False
    # texts count alike, whatever their number of lines
    line_w = np.repeat(share / np.maximum(per, 1), per)
    seen_moves = np.zeros((2, 2))
    for s in (0, 1):
        seen_moves[s, s] = inner[state == s].sum()

    def gradient(p: np.ndarray) -> np.ndarray:
        good, expected, _ = marginals(lines.features @ p[:-4], lines.first, p[-4:].reshape(2, 2))
        g = lines.features.T @ (line_w * (good - state)) / len(y)
        return np.concatenate([g + 1e-4 * p[:-4], (expected - seen_moves).ravel() / max(1, inner.sum()) + 0.05 * p[-4:]])

    p = _adam(np.zeros(N_FEATURES + 4), gradient, epochs, 0.08)
    model = Model(p[:-4], p[-4:].reshape(2, 2), np.zeros(4))
    good, _, _ = marginals(lines.features @ model.weights, lines.first, model.moves)
    x = summary(good, lines)
    model.curve = _adam(np.array([0.5, 0.0, 0.0, 0.0]), lambda c: x.T @ (1 / (1 + np.exp(-x @ c)) - y) / len(y) + 1e-3 * c, 1500, 0.02)
    seen, meant = np.clip([y.mean(), good_share], 0.02, 0.98)
    model.curve[3] += np.log(meant / (1 - meant)) - np.log(seen / (1 - seen))
    return model


def score_texts(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Score of each text, and its number of lines."""
    lines = line_features(texts)
    good, _, _ = marginals(lines.features @ model.weights, lines.first, model.moves)
    return 1 / (1 + np.exp(-np.clip(summary(good, lines) @ model.curve, -500, 500))), np.diff(lines.first)


def training_sample(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], list[int], float]:
    """Texts, labels, and the share of label 1 among all labelled documents.

    Of each label at most ``sample_docs`` whole texts of SAMPLE_BYTES together. Of several labels of a document the least counts.
    """
    marks = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    keys = saved(sample_keys(documents).join(marks, "doc_id"), "labelled")
    rows = sample_rows(documents, keys, "quality", sample_docs, SAMPLE_BYTES)
    share = keys.agg(F.avg("quality")).first()[0]
    return [r["text"] for r in rows], [r["quality"] for r in rows], 0.5 if share is None else float(share)


def quality(documents: DataFrame, model: Model) -> DataFrame:
    """One row per input row: ``doc_id, score, n_lines``.

    A null, empty or wordless text has no line and gets the score of a wholly bad one.
    Columns other than ``doc_id`` and ``text`` are ignored; repeated rows give repeated results.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)  # some hundred numbers
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                score, n = score_texts(sent.value, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(n.astype(np.int64))], names=["doc_id", "score", "n_lines"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_lines bigint")
