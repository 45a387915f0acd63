"""Token counts that follow edits (op5).

A text is cut into pre-tokens, each encoded on its own, so a text's count is a sum over
them. Runs of neighbouring pre-tokens are the leaves of a segment tree that sums
characters and tokens. An edit replaces a range of characters: the tree leads to the
pre-tokens around it, the text from a little before the edit is cut again until a cut
falls on an old one behind the edit, and only those pre-tokens are encoded; then the
sums above the touched leaves are renewed. A leaf never holds more than ``MOST`` pre-tokens:
where an edit puts in more than the touched leaves can take, new leaves follow them and the
tree over leaves is summed again. New leaves have room for three times what they hold, so
that happens once in many edits.

A cut depends on the text from its start to two characters behind its end at most, or,
in white space, to the first other character. So cuts that end three characters before
an edit hold, and from the first common cut behind it on all cuts are the old ones.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import slices

#: the public vocabulary's file, a parameter
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: how its public tokenizer cuts texts into pre-tokens
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: pre-tokens of a leaf when it is made, and at most
LEAF, MOST = 16, 64
#: pre-tokens whose counts a worker remembers
CACHE = 500_000
#: characters before an edit at which cuts may already hang on it
CONTEXT = 3

Edit = tuple[int, int, str]


class Encoder:
    """Cuts texts and counts the tokens of pre-tokens."""

    def __init__(self, ranks: bytes) -> None:
        """``ranks`` is what the vocabulary's file holds: a token in base 64 and its rank on each line."""
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.codec = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.codec.encode_ordinary(piece))
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[piece] = n
        return n


def _sums(values: list[int]) -> np.ndarray:
    """Sums of leaves of ``LEAF`` values."""
    return np.add.reduceat(np.array(values, np.int64), np.arange(0, len(values), LEAF)) if values else np.zeros(1, np.int64)


def _tree(leaves: np.ndarray) -> np.ndarray:
    """The sum tree over leaves, of a size that is a power of two."""
    size = 1 << (len(leaves) - 1).bit_length()
    tree = np.zeros(2 * size, np.int64)
    tree[size : size + len(leaves)] = leaves
    level = size
    while level > 1:
        tree[level // 2 : level] = tree[level : 2 * level].reshape(-1, 2).sum(axis=1)
        level //= 2
    return tree


@dataclass
class CountedText:
    """A text, the lengths and counts of its pre-tokens by leaf, and two sum trees over leaves.

    Node ``i`` of a tree is the sum of nodes ``2 i`` and ``2 i + 1``; leaves begin at ``size``, half the tree's length.
    """

    encoder: Encoder
    text: str
    lengths: list[list[int]]
    counts: list[list[int]]
    chars: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, encoder: Encoder, text: str) -> CountedText:
        pieces = encoder.pattern.findall(text)
        known, count = encoder.known, encoder.count
        per = [known.get(p) or count(p) for p in pieces]
        lens = [len(p) for p in pieces]
        cut = range(0, max(1, len(pieces)), LEAF)
        return cls(encoder, text, [lens[i : i + LEAF] for i in cut], [per[i : i + LEAF] for i in cut], *(_tree(_sums(values)) for values in (lens, per)))

    @property
    def size(self) -> int:
        return len(self.chars) // 2

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_pieces(self) -> int:
        return sum(map(len, self.counts))

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and the first character of it; behind the end, the last leaf."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if char - before >= self.chars[node] and self.chars[node + 1]:
                before += int(self.chars[node])
                node += 1
        return min(node - self.size, len(self.lengths) - 1), before

    def _renew(self, leaf: int) -> None:
        node = leaf + self.size
        self.chars[node], self.tokens[node] = sum(self.lengths[leaf]), sum(self.counts[leaf])
        while node > 1:
            node //= 2
            for tree in (self.chars, self.tokens):
                tree[node] = tree[2 * node] + tree[2 * node + 1]

    def edit(self, start: int, end: int, put: str) -> int:
        """Replaces characters [start, end), cut to the text, by ``put``; the number of pre-tokens encoded again."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        shift = len(put) - (end - start)
        self.text = self.text[:start] + put + self.text[end:]

        # the last cut that holds: nothing that ends later than CONTEXT before the edit, nor white space up to it
        safe = max(0, start - CONTEXT)
        while safe and self.text[safe - 1].isspace():
            safe -= 1
        leaf, at = self._leaf_at(safe)
        first_leaf, keep = leaf, 0
        for n in self.lengths[leaf]:
            if at + n > safe:
                break
            at += n
            keep += 1

        # old cuts from there on, leaf by leaf, until a new one meets them behind the edit
        old_leaf, old_place, old_at = leaf, keep, at
        lens, per = [], []
        met = False
        for m in self.encoder.pattern.finditer(self.text, at):
            here = m.start()
            if here >= start + len(put):
                old_leaf, old_place, old_at = self._forward(old_leaf, old_place, old_at, here - shift)
                if old_at == here - shift:
                    met = True
                    break
            lens.append(m.end() - here)
            per.append(self.encoder.count(m[0]))
        last_leaf = old_leaf if met else len(self.lengths) - 1
        tail = (self.lengths[last_leaf][old_place:], self.counts[last_leaf][old_place:]) if met else ([], [])
        head = (self.lengths[first_leaf][:keep], self.counts[first_leaf][:keep])
        all_lens, all_per = head[0] + lens + tail[0], head[1] + per + tail[1]
        room = last_leaf - first_leaf + 1
        if len(all_lens) > MOST * room:
            self._split(first_leaf, last_leaf + 1, all_lens, all_per)
            return len(lens)
        step = -(-len(all_lens) // room)
        for k in range(room):
            self.lengths[first_leaf + k], self.counts[first_leaf + k] = all_lens[k * step : (k + 1) * step], all_per[k * step : (k + 1) * step]
            self._renew(first_leaf + k)
        return len(lens)

    def _split(self, first: int, end: int, lens: list[int], per: list[int]) -> None:
        """Leaves [first, end) give way to as many new ones of ``LEAF`` pre-tokens as it takes, and the trees are summed again."""
        trees = []
        for tree, values in ((self.chars, lens), (self.tokens, per)):
            leaves = tree[self.size : self.size + len(self.lengths)]
            trees.append(_tree(np.concatenate([leaves[:first], _sums(values), leaves[end:]])))
        cut = range(0, len(lens), LEAF)
        self.lengths[first:end], self.counts[first:end] = [lens[i : i + LEAF] for i in cut], [per[i : i + LEAF] for i in cut]
        self.chars, self.tokens = trees

    def _forward(self, leaf: int, place: int, at: int, to: int) -> tuple[int, int, int]:
        """The first old cut at or behind ``to``."""
        while at < to:
            if place == len(self.lengths[leaf]):
                if leaf + 1 == len(self.lengths):
                    break
                leaf, place = leaf + 1, 0
                continue
            at += self.lengths[leaf][place]
            place += 1
        return leaf, place, at


def code_point_edits(text: str, edits: list[dict] | None) -> list[Edit]:
    """Edits that can be applied one after another: nulls count as nothing to replace or put."""
    out = []
    for e in edits or []:
        if e is not None:
            start = e["start"] or 0
            out.append((start, start if e["end"] is None else e["end"], e["put"] or ""))
    return out


def edited_counts(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """One row per input row: ``doc_id, n_pieces, n_tokens, n_edits, n_encoded, n_pieces_after, n_tokens_after, text_after``.

    ``documents`` has ``doc_id, text`` and ``edits``, an array of (start, end, put), applied
    in order, each to what the one before left; positions are code points and are cut to the text.
    ``n_encoded`` counts the pre-tokens that the edits had encoded again. A null text
    counts as empty; null edits are none. Other columns are ignored; repeated rows
    give rows of their own. The driver reads the file ``ranks`` and sends what it holds (0.8 MB) to the executors.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    with open(ranks, "rb") as file:
        sent = documents.sparkSession.sparkContext.broadcast(file.read())
    names = ["n_pieces", "n_tokens", "n_edits", "n_encoded", "n_pieces_after", "n_tokens_after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                rows, texts = [], []
                for text, edits in zip(part.column("text").to_pylist(), part.column("edits").to_pylist(), strict=True):
                    state = CountedText.of(encoder, text or "")
                    before = (state.n_pieces, state.n_tokens)
                    steps = code_point_edits(state.text, edits)
                    encoded = sum(state.edit(*e) for e in steps)
                    rows.append((*before, len(steps), encoded, state.n_pieces, state.n_tokens))
                    texts.append(state.text)
                columns = np.array(rows, np.int64).reshape(-1, len(names))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(columns[:, j]) for j in range(len(names))], pa.array(texts, pa.string())], names=["doc_id", *names, "text_after"])

    schema = f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", text_after string"
    return documents.select("doc_id", "text", "edits").mapInArrow(run, schema)


def review_edits(text, doc_id):
    """Three edits of a text, as a reviewer makes them: a word put in, a stretch cut, a stretch replaced.

    Where they fall follows from the length and the id alone.
    """
    n = F.coalesce(F.length(text), F.lit(0))
    place = lambda seed: F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed)), n + 1).cast("bigint")
    edit = lambda at, size, put: F.struct(at.alias("start"), (at + size).alias("end"), F.lit(put).alias("put"))
    return F.array(edit(place("put"), 0, " reviewed"), edit(place("cut"), 24, ""), edit(place("swap"), 12, "it's 2024's\n\n  text"))
