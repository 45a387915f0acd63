"""Language identification by compression (op2).

Each language has a zstandard raw-content dictionary of its own training text. A text,
lower-cased with all but letters reduced to single spaces, is compressed with each of
them, block by block, so that the dictionary counts as much at the end of a long text as
at its start; the smallest sum wins. It is rejected where the runner-up comes near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import sample_keys, sample_rows
from .textarrays import slices

#: bounds of the training sample: documents a language, bytes of a dictionary
SAMPLE_DOCS = 160
DICTIONARY_BYTES = 32 << 10
#: bytes of a language's sample
SAMPLE_BYTES = 1 << 20
#: a lazy match finder with short matches: words of a few letters count
PARAMETERS = {"strategy": zstandard.STRATEGY_LAZY2, "min_match": 4, "window_log": 17, "hash_log": 15, "chain_log": 15, "search_log": 3}
#: a text is rejected if the second language needs less than this share of its bytes, or bytes, more
MARGIN = 0.0015
LEAST_BYTES = 1
#: a text is cut into equal blocks of at most so many bytes, each compressed alone; all of them count
BLOCK_BYTES = 32 << 10
UNKNOWN = "und"

_ASCII_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_NOT_ASCII_LETTERS = bytes(b for b in range(256) if not 97 <= b <= 122)


def letters_only(text: str | None) -> bytes:
    """Lower-cased UTF-8 with ASCII digits, signs and space runs as one space; empty without any letter."""
    data = b" ".join((text or "").lower().encode("utf-8", "replace").translate(_ASCII_LETTERS).split())
    if data and not data.translate(None, _NOT_ASCII_LETTERS):
        return data if any(c.isalpha() for c in data.decode()) else b""
    return data


def blocks(data: bytes, limit: int = BLOCK_BYTES) -> list[bytes]:
    """The bytes in as few equal parts of at most ``limit`` as do; one part if they are no more."""
    n = -(-len(data) // limit)
    return [data[len(data) * k // n : len(data) * (k + 1) // n] for k in range(n)]


def dictionaries(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each non-null ``lang`` of ``doc_id, text, lang``, the language of most documents first.

    The sample is the same in each run: the documents with the smallest hash of their
    id. It is chosen on ids alone, at most ``sample_docs`` a language, and only then
    joined with the texts, each of which is taken whole or not at all; only where none
    fits into a dictionary does the first one fill it with its beginning.
    """
    has = labelled.filter("lang is not null and text is not null")
    rows = sample_rows(has, sample_keys(has, "lang"), "lang", sample_docs, SAMPLE_BYTES)
    out: dict[str, bytes] = {}
    known = {r["lang"] for r in rows}
    often = {r["lang"]: -r["count"] for r in has.groupBy("lang").count().collect() if r["lang"] in known}
    for lang in sorted(known, key=lambda x: (often[x], x)):
        parts, held, seen, first = [], 0, set(), b""
        for r in (r for r in rows if r["lang"] == lang):
            data = letters_only(r["text"])
            first = first or data
            if data and data not in seen and held + len(data) < dictionary_bytes:
                seen.add(data)
                parts.append(data)
                held += len(data) + 1
        if first:
            out[lang] = b" ".join(parts) or first[:dictionary_bytes]
    return out


class Compressors:
    """One compressor for each language, made once in a worker."""

    def __init__(self, content: dict[str, bytes]) -> None:
        self.langs = list(content)
        how = zstandard.ZstdCompressionParameters(**PARAMETERS)
        self.contexts = []
        for lang in self.langs:
            known = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=how)
            self.contexts.append(zstandard.ZstdCompressor(compression_params=how, dict_data=known))

    def sizes(self, text: str | None) -> tuple[int, list[int]]:
        """Bytes of the reduced text, and the sum of its blocks' sizes with each language; none if it has no letter."""
        data = letters_only(text)
        parts = blocks(data)
        return (len(data), [sum(len(c.compress(part)) for part in parts) for c in self.contexts]) if data else (0, [])


def decide(n_bytes: int, sizes: list[int], margin: float = MARGIN) -> tuple[int, float, bool]:
    """Index of the winner (of equals the first), its share of the odds, whether it is rejected."""
    best = int(np.argmin(sizes))
    others = sizes[:best] + sizes[best + 1 :]
    if not others:
        return best, 1.0, False
    lead = min(others) - sizes[best]
    # a byte less is a factor of 2**8 in the coder's odds; tempered for how far texts agree with themselves
    score = 1.0 / (1.0 + sum(2.0 ** (-min(1000.0, (s - sizes[best]) * 8 / (4 + n_bytes / 100))) for s in others))
    return best, score, lead < max(LEAST_BYTES, margin * n_bytes)


def _judged(tools: Compressors, texts: pa.Array, margin: float) -> tuple[list[str], list[float], list[bool]]:
    langs, scores, rejected = [], [], []
    for text in texts.to_pylist():
        n, sizes = tools.sizes(text)
        best, score, no = decide(n, sizes, margin) if sizes else (-1, 0.0, True)
        langs.append(tools.langs[best] if sizes else UNKNOWN)
        scores.append(score)
        rejected.append(no)
    return langs, scores, rejected


def identify(documents: DataFrame, content: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score, rejected``.

    ``lang_pred`` is ``und``, with score 0 and rejected, if the text is null or has no
    letter, or nothing was learned. A narrow margin rejects, but the winner is still told.
    Columns other than ``doc_id`` and ``text`` are ignored; repeated rows give repeated results.
    """
    sent = documents.sparkSession.sparkContext.broadcast(content)  # bounded by DICTIONARY_BYTES a language
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Compressors(sent.value)
        for batch in batches:
            for part in slices(batch):
                langs, scores, rejected = _judged(tools, part.column("text"), margin)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def clear_only(documents: DataFrame, content: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows that ``identify`` doesn't reject, with all their columns; no shuffle."""
    sent = documents.sparkSession.sparkContext.broadcast(content)  # bounded by DICTIONARY_BYTES a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Compressors(sent.value)
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([not no for no in _judged(tools, part.column("text"), margin)[2]], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
