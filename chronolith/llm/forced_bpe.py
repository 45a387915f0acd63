"""Encoding and decoding by byte pairs, cut where no token can reach across (op13).

A token is made of two shorter ones, so two neighbouring bytes can only end up in one
token if some merge joins a token that ends in the first to one that begins with the
second. A pair of bytes that no merge joins is a certain cut: what lies on its two
sides is encoded apart, and the ids are put one behind the other. Fragments are short
and come again and again, so most of them are looked up.

Texts are told apart into words as the vocabulary's own file says: special tokens first,
then NFC and lower case, then runs of letters, single digits and runs of other signs.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .storage import free_name
from .textarrays import give_back, slices

#: fixed value: how the vocabulary's file cuts normal text into words
WORDS = regex.compile(r"'(?:[stmd]|re|ve|ll)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: the same in ASCII of lower case, where no tables of letters are needed
ASCII_WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
#: words, and fragments of words that are cut, that a worker remembers
CACHE = 400_000
#: bytes of a word that is short: remembered, and merged by trying all its pairs
SHORT = 32
#: characters of a text whose words are found at once, and words that are found at once in a longer one
WHOLE, RUN = 1_000_000, 100_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary: visible Latin-1 signs for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, further = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(further))
        further += b not in shown
    return out


def kinds() -> np.ndarray:
    """For each code point 1 if Python's tables don't know it yet (the tokenizer's may), 2 if it goes on top of a sign before it, else 0."""
    known = [unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1)]
    return np.array([1 if k == "Cn" else 2 if k[0] == "M" else 0 for k in known], np.uint8)


class Vocabulary:
    """Ranks of merges, ids of bytes, and which neighbouring bytes some token holds."""

    def __init__(self, content: str) -> None:
        table = json.loads(content)
        model = table["model"]
        ids, ending = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + ending] for c in letters]
        edges = {c: (b, b) for b, c in enumerate(letters)} | {c + ending: (b, b) for b, c in enumerate(letters)}
        self.joined = np.zeros((256, 256), bool)
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for left, right in model["merges"]:
            self.joined[edges[left][1], edges[right][0]] = True
            edges[left + right] = (edges[left][0], edges[right][1])
            self.rank[ids[left], ids[right]] = len(self.merged)
            self.merged.append(ids[left + right])
        self.special = {x["content"]: x["id"] for x in table["added_tokens"]}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.shown = np.empty(max([*ids.values(), *self.special.values()]) + 1, object)
        for token, i in [*ids.items(), *self.special.items()]:
            self.shown[i] = token.encode()
        self.kinds = kinds()
        self.together = self.joined.tobytes()
        self.library = Tokenizer.from_str(content)
        self.letter_bytes = {c: b for b, c in enumerate(letters)}
        self.words: dict[str, bytes] = {}
        self.fragments: dict[tuple[bytes, bool], list[int]] = {}

    def cuts(self, data: bytes) -> list[int]:
        """Places in ``data`` that no token can reach across."""
        if len(data) <= SHORT:
            together = self.together
            return [i for i in range(1, len(data)) if not together[data[i - 1] << 8 | data[i]]]
        b = np.frombuffer(data, np.uint8)
        return (np.flatnonzero(~self.joined[b[:-1], b[1:]]) + 1).tolist()

    def merge(self, fragment: bytes, ends: bool) -> list[int]:
        """Ids of a fragment, by the lowest rank first and the leftmost of equal ones; ``ends``: a word ends with it."""
        at = [self.inner[b] for b in fragment]
        if ends:
            at[-1] = self.last[fragment[-1]]
        n, rank, merged = len(at), self.rank, self.merged
        if n <= SHORT:
            none = len(merged)
            while len(at) > 1:
                found = [rank.get(pair, none) for pair in zip(at, at[1:])]  # noqa: B905
                if (least := min(found)) == none:
                    break
                i = found.index(least)
                at[i : i + 2] = [merged[least]]
            return at
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(rank[pair], i) for i, pair in enumerate(zip(at, at[1:], strict=False)) if pair in rank]
        heapq.heapify(waiting)
        while waiting:
            r, i = heapq.heappop(waiting)
            j = after[i] if at[i] >= 0 else n
            if j >= n or rank.get((at[i], at[j])) != r:
                continue  # one of the two has been merged since
            at[i], at[j] = merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (again := rank.get((at[i], at[k]))) is not None:
                    heapq.heappush(waiting, (again, i))
            if (h := before[i]) >= 0 and (again := rank.get((at[h], at[i]))) is not None:
                heapq.heappush(waiting, (again, h))
        return [x for x in at if x >= 0]

    def word(self, data: bytes) -> bytes:
        """Ids of a word's bytes as little-endian 32-bit integers."""
        cuts = self.cuts(data)
        out: list[int] = [] if cuts else self.merge(data, True)
        edges = [0, *cuts, len(data)] if cuts else []
        for lo, hi in zip(edges, edges[1:], strict=False):
            key = (data[lo:hi], hi == len(data))
            found = self.fragments.get(key)
            if found is None:
                found = self.merge(*key)
                if len(self.fragments) >= CACHE:
                    self.fragments.clear()
                if hi - lo <= SHORT:
                    self.fragments[key] = found
            out += found
        return struct.pack(f"<{len(out)}I", *out)

    def _by_library(self, text: str) -> bool:
        """Whether signs younger than Python's tables, or several on top of one, leave it to the library to put a text in normal form."""
        kind = self.kinds[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        return bool((kind == 1).any() or ((kind[1:] == 2) & (kind[:-1] == 2)).any())

    def split(self, text: str) -> Iterator[list[str]]:
        """Words of a text without special tokens, those of a long one in runs; where Python's tables might differ, the library cuts."""
        if not text.isascii() and self._by_library(text):
            plain = self.library.normalizer.normalize_str(text)
            yield [bytes(map(self.letter_bytes.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
            return
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case goes by single signs: no final sigma
        words = ASCII_WORDS if text.isascii() else WORDS
        text = text.lower()
        if len(text) <= WHOLE:
            yield words.findall(text)
            return
        found = words.finditer(text)
        while run := [m.group() for m in islice(found, RUN)]:
            yield run

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        out: list[bytes] = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            for run in self.split(part):
                known = list(map(self.words.get, run))
                try:
                    out.append(b"".join(known))
                    continue
                except TypeError:  # some are not known yet
                    new = [i for i, found in enumerate(known) if found is None]
                for i in new:
                    known[i] = found = self.words.get(run[i]) or self.word(run[i].encode())
                    if len(self.words) >= CACHE:
                        self.words.clear()
                    if len(run[i]) <= SHORT:
                        self.words[run[i]] = found
                out.append(b"".join(known))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens of ids with a blank between them, as a file without a decoder of its own has it."""
        at = np.frombuffer(ids, "<u4")
        return b" ".join(b" ".join(self.shown[at[i : i + RUN]].tolist()) for i in range(0, len(at), RUN)).decode()


_KNOWN: dict[str, Vocabulary] = {}


def _vocabulary(content: str) -> Vocabulary:
    """Made once in a worker."""
    if content not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[content] = Vocabulary(content)
    return _KNOWN[content]


def round_trip(documents: DataFrame, tokenizer: str) -> DataFrame:
    """The rows of ``documents`` with ``n_tokens``, ``ids`` and ``decoded`` in place of columns of these names.

    ``tokenizer`` is the path of the vocabulary's file on the driver; its content (some MB,
    whatever the documents are) is broadcast. ``ids`` are little-endian unsigned 32-bit integers in a row,
    ``decoded`` is the text that they give. Strings of special tokens become their ids.
    A null or empty text, or one of white space, has no ids and decodes to an empty text.
    Each row is worked on alone: repeated rows, null ids and other columns stay as they
    are, an empty table stays empty, and a long text takes memory in proportion to its length.
    """
    with open(tokenizer, encoding="utf-8") as file:
        content = documents.sparkSession.sparkContext.broadcast(file.read())
    made = ["n_tokens", "ids", "decoded"]
    kept = documents.drop(*[c for c in documents.columns if c.lower() in made])
    text = free_name(kept, "text_in")
    schema = f"{kept.select('*').schema.simpleString()[7:-1]}" if kept.columns else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(content.value)
        for batch in batches:
            for part in slices(batch, text, 2 << 20):
                ids = [words.encode(t or "") for t in part.column(text).to_pylist()]
                found = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([words.decode(i) for i in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([c for c, f in zip(part.columns, part.schema, strict=True) if f.name != text] + found, names=[n for n in part.schema.names if n != text] + made)
                del ids, found
        give_back()

    if "text" not in documents.columns:
        raise ValueError("documents need a column text")
    return kept.withColumn(text, documents["text"]).mapInArrow(run, f"{schema}, n_tokens bigint, ids binary, decoded string")
