"""Secret scans: three base patterns, and a linear-chain conditional random field (op6).

Words are tagged outside, begin or inside of a secret. A word's features are its shape
(shares of character classes, length, distinct bytes), keywords in it and in the words
before and after, and how its file looks (long, full of digits). Viterbi decodes each
line. Runs of begin and inside words that no base match touches become ``crf`` spans,
without the quotes and signs around them; nothing but the field decides on them.

The base patterns teach it where secrets stand, in a bounded sample of texts. What secrets
look like is taught by lessons: the same texts with each secret drawn anew from other
alphabets, more of them among the words, and decoys (paths, names, times, addresses made of
the text's own words) that are none. Each line is learned from twice, as it is and without
the names of secrets.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import sample_keys, sample_rows
from .textarrays import LOWER, SAME, Words, slices, words_of

#: fixed values: the base patterns; "either case" means the letters A to Z
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16
KINDS = ("assign", "access", "hex", "crf")
_CUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: bounds of the training sample
SAMPLE_DOCS = 400
SAMPLE_BYTES = 600_000
EPOCHS = 60
#: training lines are cut into pieces of so many words; of pieces with a secret, with a long word only and of others at most so many are learned from
PIECE = 24
PIECES = (300, 700, 200)
#: secrets and decoys that a lesson puts among the words of a text
DRAWN, DECOYS = 4, 12

_BYTES = np.arange(256)
_CLASS = {
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "hex": ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 102)),
    "join": np.isin(_BYTES, list(b"+/_=-.")),
    "other": ~(((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | np.isin(_BYTES, list(b"+/_=-."))),
}
_HEXISH = _CLASS["hex"]
_VOWEL = np.isin(_BYTES | 32, list(b"aeiou")) & (_BYTES >= 65) & (_BYTES <= 122)
#: alphabets that lessons draw secrets from
_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALPHABETS = (_UPPER + _LOWER + _DIGIT, _UPPER + _LOWER + _DIGIT + "+/", _UPPER + _LOWER + _DIGIT + "_-", _UPPER + _DIGIT, _LOWER + _DIGIT, "0123456789ABCDEF", "0123456789abcdef")
_BODY = re.compile(rb"[A-Za-z0-9+/_.=-]+")


def base_matches(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, leftmost and apart within a kind, by start and kind."""
    found = []
    low = text.lower()
    if any(c in low for c in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_MIN]
    return sorted(found, key=lambda x: (x[0], x[2]))


def suspects(w: Words, raw: np.ndarray) -> np.ndarray:
    """Rows that may hold a base match: a cue word, an access head or a long run of hex digits."""
    n_rows = len(w.offsets) - 1
    flag = np.zeros(n_rows, bool)
    data, low = raw.tobytes(), w.data.tobytes()
    for hay, cues in ((low, _CUES), (data, (b"AKIA",))):
        for cue in cues:
            at = hay.find(cue)
            while at >= 0:
                row = int(np.searchsorted(w.offsets, at, side="right")) - 1
                flag[row] = True
                at = hay.find(cue, int(w.offsets[row + 1]) - len(cue) + 1 if w.offsets[row + 1] - len(cue) + 1 > at else at + 1)
    is_hex = _HEXISH[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_hex, [False]]).astype(np.int8)))
    a, b = edge[0::2], edge[1::2]
    long = b - a >= HEX_MIN
    # a run can go on over the end of a text: then all the texts that it touches are suspects
    low, high = (np.searchsorted(w.offsets, x, side="right") - 1 for x in (a[long], b[long] - 1))
    edge = np.bincount(low, minlength=n_rows + 1) - np.bincount(high + 1, minlength=n_rows + 1)
    flag |= np.cumsum(edge)[:n_rows] > 0
    return flag


def word_features(w: Words, raw: np.ndarray) -> np.ndarray:
    """Of each word: shape, keyword, the same of its neighbours, and its file."""
    n = len(w.start)
    length = (w.end - w.start).astype(np.float32)
    cols = [np.add.reduceat(c[raw].astype(np.int32), w.start).astype(np.float32) for c in _CLASS.values()]
    # what lies between words is white space, of class "other": taken off again
    gap = np.concatenate([w.start[1:], [len(raw)]]) - w.end
    cols[-1] -= gap
    digit, upper, lower, hexed, join, other = cols
    mixed = (np.minimum(digit, 1) + np.minimum(upper, 1) + np.minimum(lower, 1) + np.minimum(join, 1))

    def turns(kind: np.ndarray) -> np.ndarray:
        """How often a word goes into or out of a class of bytes, its first byte counted as a step from outside."""
        change = np.zeros(len(raw), np.int32)
        change[1:] = kind[raw[1:]] != kind[raw[:-1]]
        change[w.end[w.end < len(raw)]] = 0
        change[w.start] = kind[raw[w.start]]  # whatever the text before ends with
        return np.add.reduceat(change, w.start).astype(np.float32)

    changes, cases = turns(_CLASS["digit"]), turns(_CLASS["upper"])
    vowels = np.add.reduceat(_VOWEL[raw].astype(np.int32), w.start).astype(np.float32)
    key = np.zeros(n, np.float32)
    low = w.data.tobytes()
    for cue in _CUES:
        at = low.find(cue)
        while at >= 0:
            i = int(np.searchsorted(w.start, at, side="right")) - 1
            if i >= 0:
                key[i] = 1
            at = low.find(cue, at + len(cue))
    assign = np.isin(raw[w.end - 1], (58, 61)).astype(np.float32) if n else key
    own = np.stack([
        np.minimum(length, 64) / 16, (length >= 12).astype(np.float32), (length >= 20).astype(np.float32), digit / length, upper / length, join / length, other / length,
        hexed / length, (digit >= 3) * (length >= 16) * 1.0, (mixed >= 2) * (length >= 16) * 1.0, (mixed >= 3) * (length >= 16) * 1.0, np.minimum(changes, 16) / 8, key, assign, (length >= 16) * (digit / length > 0.15) * 1.0,
        np.minimum(cases, 16) / 8, vowels / length, (length >= 16) * (changes + cases >= length / 4) * 1.0, (length >= 16) * (vowels <= length / 4) * (other == 0) * 1.0, (join > 0) * (digit + join == length) * 1.0,
    ], axis=1).astype(np.float32)
    side = own[:, [0, 3, 12, 13, 14]]
    head = np.concatenate([[True], w.row[1:] != w.row[:-1]])
    tail = np.concatenate([w.row[1:] != w.row[:-1], [True]])
    before = np.concatenate([np.zeros((1, 5), np.float32), side[:-1]])
    after = np.concatenate([side[1:], np.zeros((1, 5), np.float32)])
    before[head] = 0
    after[tail] = 0
    rows = len(w.offsets) - 1
    size = np.maximum(np.bincount(w.row, length, rows), 1)
    by_file = np.stack([np.log1p(np.diff(w.first)) / 8, np.bincount(w.row, digit, rows) / size, np.bincount(w.row, key, rows) > 0], axis=1).astype(np.float32)[w.row]
    return np.concatenate([own, before, after, by_file, np.ones((n, 1), np.float32)], axis=1)


N_FEATURES = 20 + 5 + 5 + 3 + 1
#: features that come from names of secrets and from the sign behind them, of a word, its neighbours and its file
NAMES = [12, 13, 22, 23, 27, 28, 32]
_BANNED = np.array([[0, 0, -1e4], [0, 0, 0], [0, 0, 0]], np.float64)  # inside never follows outside


@dataclass
class Model:
    weights: np.ndarray  # features x 3 states: outside, begin, inside
    moves: np.ndarray


def chains(w: Words, raw: np.ndarray) -> np.ndarray:
    """First word of each line of each text, with the end last."""
    n = len(w.start)
    if not n:
        return np.zeros(1, np.int64)
    line = np.searchsorted(np.flatnonzero(raw == 10), w.start)
    return np.concatenate([np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (w.row[1:] != w.row[:-1])])), [n]])


def _steps(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    top = int(count.max()) if len(count) else 0
    return first[:-1][order], np.searchsorted(-count[order], -np.arange(1, top + 1), side="right")


def viterbi(emit: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best states of all chains, step by step together."""
    begin, reach = _steps(first)
    best = emit.astype(np.float64).copy()
    back = np.zeros(emit.shape, np.int8)
    best[begin, 2] = -1e9
    for t in range(1, len(reach)):
        i = begin[: reach[t]] + t
        through = best[i - 1][:, :, None] + moves[None]
        back[i] = through.argmax(axis=1)
        best[i] += through.max(axis=1)
    out = np.zeros(len(emit), np.int8)
    ends = first[1:] - 1
    out[ends] = best[ends].argmax(axis=1)
    for t in range(len(reach) - 1, 0, -1):
        i = begin[: reach[t]] + t
        out[i - 1] = back[i, out[i]]
    return out


def _marginals(emit: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of states by word, and of neighbouring states summed over all words; forward and backward sums are scaled step by step."""
    begin, reach = _steps(first)
    see, go = np.exp(np.maximum(emit - emit.max(axis=1, keepdims=True), -500.0)).astype(np.float64), np.exp(moves)
    see[first[:-1], 2] = 0
    a, b = np.ones(see.shape), np.ones(see.shape)
    scaled = lambda x: x / x.sum(axis=1, keepdims=True)
    for t, k in enumerate(reach):
        i = begin[:k] + t
        a[i] = scaled(see[i] * (a[i - 1] @ go) if t else see[i])
    for t in range(len(reach) - 2, -1, -1):
        i = begin[: reach[t + 1]] + t
        b[i] = scaled((see[i + 1] * b[i + 1]) @ go.T)
    inner = np.ones(len(emit), bool)
    inner[first[:-1]] = False
    i = np.flatnonzero(inner)
    pair = a[i - 1][:, :, None] * go * (see[i] * b[i])[:, None, :]
    return scaled(a * b), (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def _draw(r: np.random.Generator) -> str:
    """A secret of 16 to 64 characters; one in eight is written in two parts."""
    kind = _ALPHABETS[r.integers(len(_ALPHABETS))]
    key = "".join(kind[k] for k in r.integers(len(kind), size=r.integers(16, 65)))
    half = len(key) // 2
    return f"{key[:half]} {key[half:]}" if half >= 16 and r.random() < 0.25 else key


def _decoy(words: list[str], r: np.random.Generator) -> str:
    """What may look like a secret and is none, made of words of the text and of numbers."""
    some = [words[k] for k in r.integers(len(words), size=r.integers(2, 6))]
    number = lambda low, high: str(r.integers(low, high))
    kind = r.integers(10)
    if kind == 6:
        return "".join(some).lower()
    if kind == 7:
        return "".join(some).capitalize()
    if kind == 0:
        return "".join(x.capitalize() for x in some) + number(0, 100) * (r.random() < 0.3)
    if kind == 1:
        return "_".join(some).upper()
    if kind == 2:
        return ".".join(number(0, 256) for _ in range(4)) + f":{number(80, 9999)}" * (r.random() < 0.3)
    if kind == 3:
        return f"{number(1990, 2040)}-{number(10, 13)}-{number(10, 31)}T{number(10, 24)}:{number(10, 60)}:{number(10, 60)}.{number(100, 999)}Z"
    if kind == 4:
        return f"{some[0]}.{number(0, 2100)}@{some[1]}.example.com"
    if kind == 5:
        return "https://" + "/".join(some).lower() + f"?page={number(0, 1000)}" * (r.random() < 0.5)
    return "-_/."[r.integers(4)].join(some) + f"-{number(0, 3000)}" * (r.random() < 0.3)


def _values(text: str) -> list[tuple[int, int]]:
    """Where the secrets of base matches are, without their names, apart from each other."""
    out: list[tuple[int, int]] = []
    for a, b, kind in base_matches(text):
        a = ASSIGN.match(text, a).start(2) if kind == 0 else a
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _lesson(text: str, values: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text with secrets drawn anew, more of them if it has any, and decoys; where the secrets are now. The same for the same text."""
    r = np.random.default_rng(zlib.crc32(text.encode()))
    words = re.findall(r"[^\W\d_]{3,}", text) or ["x"]
    gaps = [m.end() for m in re.finditer(r"[^\S\n]+", text) if not any(a < m.end() and m.start() < b for a, b in values)] if values else [m.end() for m in re.finditer(r"[^\S\n]+", text)]
    put = [(a, b, "secret") for a, b in values]
    for kind, count in (("secret", DRAWN if values else 0), ("decoy", DECOYS)):
        put += [(gaps[k], gaps[k], kind) for k in r.integers(len(gaps), size=count if gaps else 0)]
    out, at, size, found = [], 0, 0, []
    for a, b, kind in sorted(put):
        new = _draw(r) if kind == "secret" else _decoy(words, r)
        size += a - at
        if kind == "secret":
            found.append((size, size + len(new)))
        new += " " if a == b else ""
        out += [text[at:a], new]
        size, at = size + len(new), b
    return "".join(out) + text[at:], found


def _labelled(texts: list[str], secrets: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and states of all words, and the first words of the pieces of their lines."""
    w = words_of(pa.array(texts, pa.string()), case=SAME, hashed=False)
    raw, w.data = w.data, LOWER[w.data]
    state = np.zeros(len(w.start), np.int64)
    if not len(w.start):
        return np.zeros((0, N_FEATURES), np.float32), state, np.zeros(1, np.int64)
    for r, (text, found) in enumerate(zip(texts, secrets, strict=True)):
        own = slice(int(w.first[r]), int(w.first[r + 1]))
        for a, b in found:
            a, b = (int(w.offsets[r]) + len(text[:x].encode()) for x in (a, b))
            low = own.start + int(np.searchsorted(w.end[own], a, side="right"))
            high = own.start + int(np.searchsorted(w.start[own], b))
            state[low:high] = 2
            state[low : low + 1] = 1
    return word_features(w, raw), state, chains(w, raw)


def _pieces(state: np.ndarray, long: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words to learn from, and where their pieces begin: at most ``PIECES`` pieces of the three kinds, spread evenly."""
    size = np.diff(first)
    n = -(-size // PIECE)
    which = np.repeat(np.arange(len(size)), n)
    start = first[which] + PIECE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    stop = np.minimum(start + PIECE, first[which + 1])
    kind = np.where(np.maximum.reduceat(state, start) > 0, 0, np.where(np.maximum.reduceat(long, start), 1, 2)) if len(start) else start
    of_kind = [np.flatnonzero(kind == x) for x in range(3)]
    kept = np.sort(np.concatenate([k[np.unique(np.linspace(0, len(k) - 1, min(len(k), most)).astype(np.int64))] for k, most in zip(of_kind, PIECES, strict=True)]))
    size = (stop - start)[kept]
    first = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(start[kept] - first[:-1], size) + np.arange(first[-1]), first


def fit(texts: list[str], epochs: int = EPOCHS) -> Model:
    """Learns from base matches; without any, the model finds nothing."""
    nothing = Model(np.zeros((N_FEATURES, 3)) + np.array([1.0, 0.0, 0.0]) * (np.arange(N_FEATURES) == N_FEATURES - 1)[:, None], _BANNED.copy())
    secrets = [_values(t) for t in texts]
    if not any(secrets):
        return nothing
    lessons = [_lesson(t, v) for t, v in zip(texts, secrets, strict=True)]
    x, state, first = _labelled(texts + [t for t, _ in lessons], secrets + [v for _, v in lessons])
    chosen, first = _pieces(state, x[:, 1] > 0, first)
    x, state = x[chosen], state[chosen]
    state[first[:-1]] = np.where(state[first[:-1]] == 2, 1, state[first[:-1]])  # a secret that a piece cuts begins there
    # every piece once more without what names a secret, so that its own shape has to tell it
    blind = x.copy()
    blind[:, NAMES] = 0
    x, state, first = np.concatenate([x, blind]), np.concatenate([state, state]), np.concatenate([first, first[1:] + len(state)])
    inner = np.ones(len(state), bool)
    inner[first[:-1]] = False
    i = np.flatnonzero(inner)
    real = np.eye(3)[state]
    real_pair = np.zeros((3, 3))
    np.add.at(real_pair, (state[i - 1], state[i]), 1)
    scale = max(1, int((state > 0).sum()))
    p = np.zeros(N_FEATURES * 3 + 9)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, epochs + 1):
        weights, moves = p[:-9].reshape(N_FEATURES, 3), p[-9:].reshape(3, 3) + _BANNED
        prob, pair = _marginals(x @ weights, first, moves)
        g = np.concatenate([(x.T @ (prob - real)).ravel(), (pair - real_pair).ravel()]) / scale + 1e-3 * p
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(p[:-9].reshape(N_FEATURES, 3), p[-9:].reshape(3, 3) + _BANNED)


def _bare(word: bytes) -> tuple[int, int]:
    """The longest stretch of the bytes that secrets are made of, the first of equals; all of a word without any."""
    return max(((m.start(), m.end()) for m in _BODY.finditer(word)), key=lambda s: s[1] - s[0], default=(0, len(word)))


def scan_texts(model: Model, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind) in code points of each text's spans, by start and kind."""
    w = words_of(texts, case=SAME, hashed=False)
    raw, w.data = w.data, LOWER[w.data]
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    if not len(w.start):
        return out
    for r in np.flatnonzero(suspects(w, raw)).tolist():
        out[r] = base_matches(texts[r].as_py())
    tags = viterbi(word_features(w, raw) @ model.weights, chains(w, raw), model.moves)
    begins = np.flatnonzero(tags == 1)
    if not len(begins):
        return out
    stops = np.flatnonzero(np.concatenate([tags[1:] != 2, [True]]))
    rows = w.row[begins]
    for r in np.unique(rows).tolist():
        base = out[r]
        reach = np.maximum.accumulate([b for _, b, _ in base]) if base else []
        point = np.cumsum((raw[w.offsets[r] : w.offsets[r + 1]] & 0xC0) != 0x80)  # code points up to each byte
        added = []
        for i in begins[np.searchsorted(rows, r) : np.searchsorted(rows, r, side="right")].tolist():
            last = int(stops[np.searchsorted(stops, i)])
            lo = int(w.start[i]) + _bare(raw[w.start[i] : w.end[i]].tobytes())[0]
            hi = int(w.start[last]) + _bare(raw[w.start[last] : w.end[last]].tobytes())[1]
            a, b = int(point[lo - w.offsets[r]]) - 1, int(point[hi - 1 - w.offsets[r]])
            before = bisect_left(base, (b,))  # base spans that begin before this one's end
            if not before or reach[before - 1] <= a:
                added.append((a, b, 3))
        base += added
    for spans in out:
        spans.sort(key=lambda x: (x[0], x[2]))
    return out


def training_sample(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[str]:
    """Two bounded sets of whole texts by the smallest hash of the id: with a likely base match, and without."""
    likely = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}")
    return [r["text"] for r in sample_rows(documents, sample_keys(documents, likely.alias("likely")), "likely", sample_docs // 2, SAMPLE_BYTES)]


def scan(documents: DataFrame, model: Model) -> DataFrame:
    """One row per input row: ``doc_id, spans`` (array of start, end, kind; code points).

    Null counts as empty. Spans of one kind never overlap; model spans overlap no other.
    Columns other than ``doc_id`` and ``text`` are ignored.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)  # about a hundred numbers
    kind = documents.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [[{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in spans] for spans in scan_texts(sent.value, part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, span)], names=["doc_id", "spans"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<start: bigint, end: bigint, kind: string>>")


def _redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each stretch that spans cover replaced by the mark."""
    out, at = [], 0
    reach = 0
    for a, b, _ in sorted(spans):
        if a >= reach:
            out += [text[at:a], mark]
        reach = at = max(reach, b)
    return "".join(out) + text[at:]


def redact(documents: DataFrame, model: Model, mark: str) -> DataFrame:
    """All rows with all columns; in ``text`` each secret (overlapping spans as one) becomes ``mark``. Null stays null."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # about a hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                found = {i: spans for i, spans in enumerate(scan_texts(sent.value, texts)) if spans}
                if found:
                    new = pa.array([_redacted(t, found[i], mark) if i in found else t for i, t in enumerate(texts.to_pylist())], texts.type)
                    part = part.set_column(part.schema.get_field_index("text"), "text", new)
                yield part

    return documents.mapInArrow(run, documents.schema)
