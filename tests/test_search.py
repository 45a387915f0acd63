"""Quotes held by texts, against all pairs."""

from chronolith.functions import text as T
from chronolith.operators import search
from pyspark.sql import functions as F

QUOTES = [
    (1, "alpha beta gamma delta"), (2, "pha beta gam"), (3, "beta gamma"), (4, "zeta"), (5, ""), (6, None), (7, "a b c"),
    (8, "the the the rare"), (9, "one two three four five six"), (10, "Ёлка  растёт здесь"), (11, "eta gamm"), (12, "nine ten eleven twelve thirteen fourteen"),
]
TEXTS = [
    (1, "alpha beta gamma delta epsilon"), (2, "Alpha  BETA"), (3, "the end"), (4, "one two three four"), (5, ""), (6, None), (7, "елка растет здесь и там"),
    (8, "six five four"), (9, "beta gamma"), (10, "x a b c y"), (11, "rare the"), (12, "seven"), (13, "one two three four"),
]


def test_holders_are_those_of_all_pairs(spark):
    q = spark.createDataFrame(QUOTES, "item long, quote string")
    t = spark.createDataFrame(TEXTS, "doc long, body string")
    judged = q.filter("quote is not null").crossJoin(t).filter(T.quote_supported(F.col("quote"), F.col("body")))
    want = sorted((r["item"], r["doc"]) for r in judged.collect())
    got = sorted((r["item"], r["doc"]) for r in search.holders(q, "item", t, "doc").collect())
    assert got == want and (2, 1) in want and (9, 8) not in want and (4, 12) in want


def test_holders_of_nothing(spark):
    q = spark.createDataFrame(QUOTES, "item long, quote string")
    t = spark.createDataFrame(TEXTS, "doc long, body string")
    assert search.holders(q.limit(0), "item", t, "doc").count() == 0
    assert search.holders(q, "item", t.limit(0), "doc").count() == 0


def test_long_quotes_are_judged_without_their_texts(spark):
    """Ends inside longer words, repeated words, exactly 60% and just less, words that all texts have."""
    common = "of the and to in"
    q = spark.createDataFrame([
        (1, "pha beta gamma delta eps"), (2, f"{common} rare"), (3, "red red red blue green"), (4, "aa bb cc dd ee ff gg hh ii jj"), (5, "x yy zz ww vv uu"),
    ], "item long, quote string")
    t = spark.createDataFrame([
        (1, "alpha beta gamma delta epsilon"), (2, "red"), (3, "blue green"), (4, "aa bb cc dd ee ff"), (5, "jj ii hh gg ff"), (6, "zz yy ww"),
        *[(10 + i, f"{common} {i}") for i in range(30)], (50, "of the rare"), (51, "of the in rare"),
    ], "doc long, body string")
    judged = q.crossJoin(t).filter(T.quote_supported(F.col("quote"), F.col("body")))
    want = sorted((r["item"], r["doc"]) for r in judged.collect())
    got = sorted((r["item"], r["doc"]) for r in search.holders(q, "item", t, "doc").collect())
    assert got == want and {(1, 1), (2, 10), (3, 2), (4, 4), (5, 6), (2, 51)} <= set(got) and not {(4, 5), (3, 3), (2, 50)} & set(got)


def test_terms_are_counted_where_they_are(spark):
    """Ids that come once are not dealt out with their words; an id that comes twice counts once, a null one never."""
    rows = [("a", "1", "one two"), ("a", "2", "two Two three"), ("a", "3", None), ("b", "1", "two")]
    frames = spark.createDataFrame(rows, "series string, id string, ocr string")
    found = search.reliable_terms(frames)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and " id#" in x]
    assert [tuple(r) for r in found.collect()] == [("a", "two", 2)]
    twice = frames.union(spark.createDataFrame([("a", "1", "one"), ("a", None, "one three"), ("a", None, "three")], frames.schema))
    assert [tuple(r) for r in search.reliable_terms(twice).collect()] == [("a", "two", 2)]


def test_postings_are_dealt_out_as_lists(spark):
    """Lists are those of plain loops, whatever the order of texts and the size of batches; no row of a gram and a text is dealt out."""
    texts = ["abcabc", "", None, "ab", "xabcx", "\U0001f600ab\U0001f600abc", "Ёлка\nёлка", "a\x00bc"] * 40
    rows = [(k * 7 % 320, (k * 7 % 320) >> 6, texts[k]) for k in range(320)]
    body = spark.createDataFrame(rows, "doc long, block long, body string").repartition(3)
    want = {}
    for doc, block, text in rows:
        for gram in {text.lower()[i : i + 3] for i in range(len(text) - 2)} if text else ():
            want.setdefault((gram, block), set()).add(doc)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        found = search.packed_postings(body)
        lists = found.collect()
        plain = search.postings(body.select(F.lit(1).alias("series"), F.col("doc").cast("string").alias("ref"), "body")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {}
    for r in lists:
        assert (r.gram, r.block) not in got and r.n == len(r.gaps)
        doc, docs = r.first, []
        for gap in r.gaps:
            doc += gap
            docs.append(doc)
        got[r.gram, r.block] = docs
    assert got == {key: sorted(docs) for key, docs in want.items()}
    assert sorted((r.gram, int(r.ref)) for r in plain) == sorted((gram, doc) for (gram, _), docs in want.items() for doc in docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_postings_are_read_once_for_a_union(spark):
    """What holds all grams is worked out once, not for each part of a corpus."""
    speech = spark.createDataFrame([("a", "speech", 1.0, "seg#1", "alpha beta", 1)], "series string, kind string, t double, ref string, body string, place long")
    screen = spark.createDataFrame([("a", "screen", 2.0, "f1", "the Alpha", 1)], speech.schema)
    body = speech.unionByName(screen)
    found = search.search_postings(search.postings(body), body, "alpha")
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.ref for r in found.collect()] == ["seg#1", "f1"]


def test_texts_are_read_again_for_short_quotes_alone(spark):
    """Quotes of five words or more are judged by numbers of words, repeats by weight; texts are behind a cut."""
    q = spark.createDataFrame([(1, "red red red blue blue green one two"), (2, "aa bb cc dd ee ff gg")], "item long, quote string")
    t = spark.createDataFrame([(1, "red blue"), (2, "blue green one two"), (3, "aa bb cc dd ee"), (4, "gg ff ee dd")], "doc long, body string")
    judged = q.crossJoin(t).filter(T.quote_supported(F.col("quote"), F.col("body")))
    found = search.holders(q, "item", t, "doc")
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == sorted((r["item"], r["doc"]) for r in judged.collect()) == [(1, 1), (1, 2), (2, 3)]
