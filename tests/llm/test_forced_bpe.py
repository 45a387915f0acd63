"""Ids and decoded texts against the tokenizers library on the same file."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronolith.llm.forced_bpe import SHORT, Vocabulary, round_trip

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "A", "'s", "'", "'LL", "Σ", "ΣΑΣ", "é", "é", "İ", "<|endoftext|>", "<|startoftext|>", "<|end", "Ᲊ", "\U00011de0", " ", "\n", "\x1c", "\x85", "９", "²", "日", "\U0001f600", "̈", "̘", "᫇", "ﬁ", "ǅ", "!!", "the"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def words():
    with open(PATH) as file:
        return Vocabulary(file.read())


def agree(words, library, text):
    ids = words.encode(text)
    theirs = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == theirs
    assert words.decode(ids) == library.decode(theirs, skip_special_tokens=False)


def test_any_text(words, library):
    @settings(max_examples=600, deadline=None)
    @given(st.lists(st.one_of(st.sampled_from(PARTS), st.characters(exclude_categories=["Cs"])), max_size=20))
    def run(parts):
        agree(words, library, "".join(parts))

    run()


def test_long_words(words, library):
    r = random.Random(3)
    for text in ("a" * 30_000, "ab" * 20_000 + "xyz", "é" * 9_000, "".join(r.choice("etaoinqz") for _ in range(30_000)), "9" * 5_000, "!" * 5_000):
        agree(words, library, text)


def test_texts_of_many_runs(words, library, monkeypatch):
    from chronolith.llm import forced_bpe

    monkeypatch.setattr(forced_bpe, "WHOLE", 50)
    monkeypatch.setattr(forced_bpe, "RUN", 7)
    agree(words, library, "Some words, and <|endoftext|> others' " * 40)


def test_no_token_reaches_across_a_cut(words, library):
    letters = {c: b for c, b in words.letter_bytes.items()}
    ending = "</w>"
    for token in library.get_vocab():
        if token in words.special:
            continue
        body = token[: -len(ending)] if token.endswith(ending) and token != ending else token
        data = bytes(letters[c] for c in body)
        assert words.cuts(data) == []
    assert words.joined.mean() < 0.1
    data = bytes(random.Random(1).randrange(256) for _ in range(SHORT))
    assert words.cuts(data + b"") == [i for i in range(1, SHORT) if not words.joined[data[i - 1], data[i]]]


def test_odd_rows(spark, odd, none, library):
    got = round_trip(odd, PATH).collect()
    assert len(got) == odd.count()
    texts = {x.doc_id: x.text for x in odd.collect() if x.doc_id is not None}
    for x in got:
        if x.doc_id is not None:
            theirs = library.encode(texts[x.doc_id] or "", add_special_tokens=False).ids
            assert np.frombuffer(x.ids, "<u4").tolist() == theirs and x.n_tokens == len(theirs)
            assert x.decoded == library.decode(theirs, skip_special_tokens=False)
    assert round_trip(none, PATH).count() == 0
    clashing = odd.withColumnRenamed("key", "ids").withColumnRenamed("row", "text_in")
    assert round_trip(clashing, PATH).columns == [*[c for c in clashing.columns if c != "ids"], "n_tokens", "ids", "decoded"]
