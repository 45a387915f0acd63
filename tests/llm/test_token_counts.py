"""Counts after edits against counting the edited text anew."""

import random
import shutil
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

from chronolith.llm.token_counts import LEAF, MOST, RANKS, CountedText, Encoder, edited_counts

ENCODER = Encoder(Path(RANKS).read_bytes())
PARTS = ["a", "b", " ", "  ", "\n", "'", "l", "re", "s", "9", "12", ".", "!", "é", " ", "\t", "日", "'ll", "Word"]


def fresh(text):
    return len(ENCODER.codec.encode_ordinary(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=200), st.lists(st.tuples(st.integers(0, 260), st.integers(0, 60), st.lists(st.sampled_from(PARTS), max_size=30)), max_size=5))
def test_edits_keep_counts_and_cuts(parts, edits):
    c = CountedText.of(ENCODER, "".join(parts))
    for start, size, put in edits:
        c.edit(start, start + size, "".join(put))
        again = CountedText.of(ENCODER, c.text)
        assert sum(c.counts, []) == sum(again.counts, [])
        assert sum(c.lengths, []) == sum(again.lengths, [])
        assert c.n_tokens == fresh(c.text) and int(c.chars[1]) == len(c.text)


def test_only_the_neighbourhood_is_encoded():
    c = CountedText.of(ENCODER, "some words here " * 20_000)
    assert c.edit(150_000, 150_004, "other") < 20
    assert c.n_tokens == fresh(c.text)


def test_a_large_insertion_makes_leaves():
    """10^5 words put into a short text, then 300 small edits there: no leaf grows over its bound, and sums stay those of the text."""
    c = CountedText.of(ENCODER, "a short text of some words")
    assert c.edit(8, 8, "put in " * 50_000) >= 100_000
    assert max(map(len, c.lengths)) == LEAF and len(c.lengths) > 6_000
    r = random.Random(3)
    for _ in range(300):
        at = r.randrange(len(c.text))
        assert c.edit(at, at + r.randrange(9), r.choice(["", " x", "it's", " one two three"])) < 30
    for _ in range(40):  # all at one place, until its leaves are full and more
        assert c.edit(5_000, 5_000, " w" * 30) < 60
    assert max(map(len, c.lengths)) <= MOST and c.size >= len(c.lengths)
    again = CountedText.of(ENCODER, c.text)
    assert sum(c.lengths, []) == sum(again.lengths, []) and sum(c.counts, []) == sum(again.counts, [])
    leaves = slice(c.size, c.size + len(c.lengths))
    assert c.chars[leaves].tolist() == [sum(x) for x in c.lengths] and c.tokens[leaves].tolist() == [sum(x) for x in c.counts]
    assert c.n_tokens == again.n_tokens == fresh(c.text) and int(c.chars[1]) == len(c.text)


def test_executors_need_no_file(spark, tmp_path):
    ranks = tmp_path / "ranks"
    shutil.copy(RANKS, ranks)
    df = spark.createDataFrame([(1, "some text", [(0, 0, "more ")])], "doc_id bigint, text string, edits array<struct<start: int, end: int, put: string>>")
    counted = edited_counts(df, str(ranks))
    ranks.unlink()
    (row,) = counted.collect()
    assert (row.n_tokens, row.n_tokens_after) == (fresh("some text"), fresh("more some text"))


def test_odd_rows(spark, odd, none):
    r = random.Random(2)
    edits = {i: [(r.randint(-5, 90), r.choice([None, 3, 500]), r.choice(["", " put", None]))] for i in range(12)}
    given_edits = spark.createDataFrame([(i, e) for i, e in edits.items()], "doc_id bigint, edits array<struct<start: int, end: int, put: string>>")
    df = odd.join(given_edits, "doc_id", "left")
    got = edited_counts(df).collect()
    assert len(got) == odd.count()
    texts = {x.doc_id: x.text for x in odd.collect() if x.doc_id is not None}
    for x in got:
        assert x.n_tokens_after == fresh(x.text_after)
        if x.doc_id is not None:
            assert x.n_tokens == fresh(texts[x.doc_id] or "")
        else:
            assert x.n_edits == 0
    assert edited_counts(none.join(given_edits, "doc_id", "left")).count() == 0
