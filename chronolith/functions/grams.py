"""Trigrams of whole texts as numpy arrays: distinct ones of each text, and the texts of each one.

A batch is cut into slices of about 2 MB of text, or one longer text, so that memory stays bounded.
Three code points are packed into one number, 21 bits each, in order of their letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

TRIGRAM = 3
SLICE_BYTES = 2 << 20
_BITS = 21


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold at most ``SLICE_BYTES``, or one row."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)), dtype=np.int64)
    lo, base = 0, 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        yield batch.slice(lo, hi - lo)
        lo, base = hi, int(ends[hi - 1])


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place that begins a trigram its text and the number of the trigram, and the trigrams packed. Null counts as empty."""
    listed = [t or "" for t in texts.to_pylist()]
    points = np.frombuffer("".join(listed).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, listed), np.int64, len(listed))
    starts = np.maximum(lengths - (TRIGRAM - 1), 0)
    if not starts.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(listed)), starts)
    at = np.arange(len(row)) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(starts) - starts), starts)
    packed = points[at] << (2 * _BITS) | points[at + 1] << _BITS | points[at + 2]
    code, known = pd.factorize(packed)
    return row, code.astype(np.int64), known


def spelled(packed: np.ndarray) -> pa.Array:
    """Packed trigrams as strings."""
    mask = (1 << _BITS) - 1
    points = np.stack([packed >> (2 * _BITS), packed >> _BITS & mask, packed & mask], axis=1).astype("<u4")
    letters = points.tobytes().decode("utf-32-le")
    return pa.array([letters[i : i + TRIGRAM] for i in range(0, len(letters), TRIGRAM)], pa.string())


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def of_each_text(texts: pa.Array) -> pa.Array:
    """The distinct trigrams of each text, as lists."""
    row, code, known = occurrences(texts)
    pairs = _distinct(row * max(1, len(known)) + code)
    ends = np.searchsorted(pairs, np.arange(len(texts) + 1) * max(1, len(known)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spelled(known).take(pa.array(pairs % max(1, len(known)))))


def listed(texts: pa.Array, group: np.ndarray, number: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """Of each trigram and group of texts the trigram, the group, the least number of a text that holds it, and all of these as rising distances from the least."""
    order = np.lexsort((number, group))
    group, number = group[order], number[order]
    row, code, known = occurrences(texts.take(pa.array(order)))
    pairs = _distinct(code * len(texts) + row)
    code, row = pairs // max(1, len(texts)), pairs % max(1, len(texts))
    new = np.ones(len(pairs), bool)
    new[1:] = (code[1:] != code[:-1]) | (group[row[1:]] != group[row[:-1]])
    first = np.flatnonzero(new)
    least = number[row[first]]
    ends = np.append(first, len(pairs))
    beyond = number[row] - np.repeat(least, np.diff(ends))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(beyond.astype(np.int32)))
    return spelled(known).take(pa.array(code[first])), group[row[first]], least, lists


def merged(group: np.ndarray, least: np.ndarray, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lists of one group, which stand together, as one list: where each group begins, its least number, and differences from one number to the next, 0 first."""
    at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.asarray(lists.offsets))
    number = np.repeat(least, sizes) + np.asarray(lists.flatten())
    of = np.repeat(np.cumsum(np.append(False, group[1:] != group[:-1])), sizes)
    gaps = np.diff(number, prepend=number[:1])
    same = np.append(False, of[1:] == of[:-1])
    if (gaps[same] < 0).any():
        number = number[np.lexsort((number, of))]
        gaps = np.diff(number, prepend=number[:1])
    gaps[~same] = 0
    first = np.flatnonzero(~same)
    return at, number[first], pa.ListArray.from_arrays(pa.array(np.append(first, len(number)), pa.int32()), pa.array(gaps.astype(np.int32)))
