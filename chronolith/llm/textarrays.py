"""Whole texts as numpy arrays: words, their hashes and their runs.

An Arrow column of texts is cut into slices of about half a MB, and each slice becomes
flat arrays (one entry a word), so that memory stays bounded whatever the batch
holds; a single longer text makes a slice of its own. Words are found in UTF-8
bytes; the separators of all operators here are ASCII, so that is exact.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: small enough for the arrays of a slice, up to 100 times its size, to weigh little beside a worker's imports
SLICE_BYTES = 512 << 10
PIECE_BYTES = 2 << 20

#: of the C library, where it has it
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
SAME = _BYTES.astype(np.uint8)
#: bytes of words ``[^\x20\x09-\x0D]+``
SPACED = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
ALNUM = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122))
#: first bytes of code points
HEADS = (_BYTES & 0xC0) != 0x80

_SEEDED = np.random.default_rng(20240607)
_BYTE_KEYS = _SEEDED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_KEYS = _SEEDED.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GRAM_KEYS = _SEEDED.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads every bit (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def give_back() -> None:
    """Hands memory that arrays no longer use back to the machine: a worker that lives on would keep its highest mark."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold at most ``limit`` bytes, or one row."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)), dtype=np.int64)
    lo, base = 0, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo, base = hi, int(ends[hi - 1])
    give_back()


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and where each begins, with the end last; null counts as empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


@dataclass
class Words:
    """Words of a slice: bytes [start, end) of ``data``, their row, their hash."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each row the index of its first word, with the end last


def words_of(texts: pa.Array, kind: np.ndarray = SPACED, case: np.ndarray = LOWER, hashed: bool = True) -> Words:
    raw, off = buffer(texts)
    data = case[raw]
    heads = np.zeros(len(data) + 1, bool)
    heads[off] = True
    starts, ends, hashes = [], [], []
    lo, total = 0, len(data)
    while lo < total:
        hi = min(total, lo + PIECE_BYTES)
        if hi < total:  # cut behind a separator, so that no word is cut
            gaps = np.flatnonzero(~kind[data[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
            else:
                more = np.flatnonzero(~kind[data[hi:]])
                hi = hi + int(more[0]) + 1 if len(more) else total
        part = data[lo:hi]
        word = kind[part]
        new = word.copy()
        new[1:] &= ~word[:-1] | heads[lo + 1 : hi]
        last = word.copy()
        last[:-1] &= ~word[1:] | heads[lo + 1 : hi]
        s, e = np.flatnonzero(new), np.flatnonzero(last) + 1
        starts.append(s + lo)
        ends.append(e + lo)
        if hashed and len(s):
            place = np.arange(len(part), dtype=np.int32)
            place -= np.repeat(np.concatenate([[0], s]).astype(np.int32), np.diff(np.concatenate([[0], s, [len(part)]])))
            key = np.where(word, _BYTE_KEYS[part], np.uint64(0))
            key *= _PLACE_KEYS[place & 4095]
            if len(part) > 4096 and (e - s).max() > 4096:
                key += key * (place >> 12).astype(np.uint64)
            hashes.append(mix(np.add.reduceat(key, s) ^ (e - s).astype(np.uint64)))
        lo = hi
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    first = np.searchsorted(start, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(data, off, start, end, row, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), first)


#: of a word's last eight bytes those that are its own, by their number
_OWN = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: longer words are hashed one at a time
LONG_WORD = 256


def hashed_by_eights(w: Words) -> np.ndarray:
    """Another hash of each word, by eight bytes at once; other values than ``Words.hash``, and cheaper."""
    data = np.concatenate([w.data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(w.data) + 1, "<u8", data, strides=(1,))
    size = w.end - w.start
    out = size.astype(np.uint64) * _PLACE_KEYS[0]
    at, left, of = w.start, size, slice(None)
    for _ in range(LONG_WORD // 8):
        out[of] = mix(out[of] ^ (eight[at] & _OWN[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        of = more if isinstance(of, slice) else of[more]
        at, left = at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(w.data[w.start[k] : w.end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def grams(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each place on, and whether they lie in one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * GRAM_KEYS[j]
    return mix(out), row[:n] == row[k - 1 :]


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte, and in all."""
    return np.concatenate([[0], np.cumsum(HEADS[data], dtype=np.int64)])
