"""Language identification: held-out accuracy, and odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from chronolith.llm import langid, queries

SF01 = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.op2_language_id(spark, SF01).toPandas()
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs)
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.96
    clear = held[~held.rejected]
    assert (clear.lang_pred == clear.lang).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_odd_rows(odd, none):
    known = langid.dictionaries(odd)
    assert set(known) <= {"en", "de"}
    got = langid.identify(odd, known).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0 for i in (4, 5, 6, 10))
    assert by[9].lang_pred != "und"
    assert langid.identify(none, known).count() == 0
    assert langid.dictionaries(none) == {}
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}
    kept = langid.clear_only(odd, known)
    assert kept.columns == odd.columns
    assert kept.filter("doc_id in (4, 5, 6, 10)").count() == 0


def test_whole_text_decides():
    """What stands behind a long head counts, also beyond the first block."""
    r = random.Random(1)
    words = {lang: ["".join(r.choice(letters) for _ in range(7)) for _ in range(300)] for lang, letters in (("a", "abcdefghijkl"), ("b", "mnopqrstuvwx"))}
    tools = langid.Compressors({lang: " ".join(w).encode() for lang, w in words.items()})
    said = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    for head, tail, winner in ((400, 100, "a"), (400, 900, "b"), (5000, 2000, "a"), (5000, 9000, "b")):
        n, sizes = tools.sizes(said("a", head) + " " + said("b", tail))
        assert n > 7 * (head + tail) and tools.langs[langid.decide(n, sizes)[0]] == winner
    assert langid.decide(100, [50, 50])[2]
    assert not langid.decide(100, [20, 50])[2]


def test_every_row_against_a_plain_loop(spark, odd):
    """Blocks of a text, compressed by themselves behind each language's dictionary, summed."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") - 1000).alias("doc_id"), "text"))
    known = langid.dictionaries(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    how = zstandard.ZstdCompressionParameters(**langid.PARAMETERS)

    def plain(text):
        data = b" ".join(re.sub(rb"[^a-z\x80-\xff]+", b" ", (text or "").lower().encode()).split())
        if not any(c.isalpha() for c in data.decode()):
            return "und", True
        n = -(-len(data) // (32 << 10))
        parts = [data[len(data) * k // n : len(data) * (k + 1) // n] for k in range(n)]
        sizes = {lang: sum(len(zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(x)) for x in parts) for lang, d in known.items()}
        first, second = sorted(sizes.values())[:2]
        return min(sizes, key=sizes.get), second - first < max(1, 0.0015 * len(data))

    got = Counter((r.doc_id, r.lang_pred, r.rejected) for r in langid.identify(docs, known).collect())
    assert got == Counter((r.doc_id, *plain(r.text)) for r in docs.collect())


def test_a_dictionary_is_bounded(spark):
    docs = spark.createDataFrame([(1, "a long text " * 10_000, "en"), (2, "kurz", "de")], "doc_id bigint, text string, lang string")
    assert {k: len(v) for k, v in langid.dictionaries(docs).items()} == {"en": langid.DICTIONARY_BYTES, "de": 4}


@pytest.fixture(scope="module")
def joined():
    """Dictionaries of three quarters of the texts of each language, and the others' texts."""
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    known, others = {}, {}
    for r in sorted((r for r in rows if r["text"] and r["lang"]), key=lambda r: zlib.crc32(b"x%d" % r["doc_id"])):
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2:
            others.setdefault(r["lang"], []).append(r["text"])
        elif len(known.get(r["lang"], b"")) < langid.DICTIONARY_BYTES:
            known[r["lang"]] = known.get(r["lang"], b"") + b" " + langid.letters_only(r["text"])
    return known, others


def test_length_does_not_reject(joined):
    """A clean text of any length keeps its lead: what the dictionary saves does not end with the first window."""
    known, others = joined
    tools = langid.Compressors(known)
    for lang, texts in others.items():
        whole = "\n".join(texts)
        whole *= -(-3_000_000 // len(whole))
        for n in (30_000, 200_000, 1_000_000, 3_000_000):
            size, sizes = tools.sizes(whole[:n])
            best, _, rejected = langid.decide(size, sizes)
            assert tools.langs[best] == lang and not rejected, (lang, n, sizes)


def test_blocks_are_the_whole_text():
    data = bytes(range(256)) * 1000
    for n in (0, 1, langid.BLOCK_BYTES, langid.BLOCK_BYTES + 1, len(data)):
        parts = langid.blocks(data[:n])
        assert b"".join(parts) == data[:n] and all(0 < len(p) <= langid.BLOCK_BYTES for p in parts)
