"""Audit of filters against loops over rows, orders and steps."""

import random
import re
from collections import Counter
from itertools import permutations

from chronolith.llm import filter_audit
from chronolith.llm.filter_audit import audit, masks

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(i, text, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
    out += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
    return out + "E" * any(i is not None and j is not None and j < i and (t or "") == text for j, t, _ in rows)


def plain(rows, labels):
    """``rows``: id, text, lang; ``labels``: id, quality, toxic."""
    known = [(lang or "", fails(i, text or "", rows), i) for i, text, lang in rows]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    out = []
    for part in {p for p, _, _ in known}:
        own = [(f, i) for p, f, i in known if p == part]
        found, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = list(own)
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[0]]
                left = [x for x in left if name not in x[0]]
                failing = sum(name in f for f, _ in own)
                found.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(f == name for f, _ in own), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)))
                shapley[name] += len(gone)
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


def same(spark, documents, labels):
    got = audit(documents, labels)
    assert got.columns == COLUMNS
    expected = plain([(r.doc_id, r.text, r.lang) for r in documents.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert sorted(map(tuple, got.collect())) == expected


def test_any_texts(spark):
    r = random.Random(4)
    texts = ["", " ", "x" * 5, "ABC def", "a # b", None, " ".join(f"w{i}" for i in range(120)), "w " * 150, "W " * 150, " ".join(f"W{i}|" for i in range(130)), "tail \x0b é"]
    rows = [(r.choice([None, *range(60)]), r.choice(texts), r.choice([None, "", "en", "de"])) for _ in range(300)]
    labels = [(r.choice([None, *range(70)]), r.choice([None, 0, 1]), r.choice([None, 0, 1])) for _ in range(80)]
    same(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(2, 1, 0, "x"), (2, 0, 1, "x"), (8, 1, 1, "x"), (None, 1, 1, "x"), (99, 1, 1, "x")], "doc_id bigint, quality int, toxic int, lang string")
    same(spark, odd, labels)
    same(spark, odd, labels.limit(0))
    assert audit(none, labels).count() == 0


def test_texts_that_share_a_hash(spark, monkeypatch):
    """All hashes equal, and a task that holds next to nothing: chains of full texts still tell all apart."""
    monkeypatch.setattr(filter_audit, "HELD_BYTES", 500)
    rows = [(7, f"t{i % 9}", "en", i) for i in range(5)] + [(7, f"t{i % 9}", "en", i) for i in range(100)] + [(7, "t3", "de", -1), (7, "t3", "fr", -1)]
    df = spark.createDataFrame(rows, "h bigint, text string, part string, doc_id bigint").selectExpr("h", "doc_id", "part", "0 as mask", "text").repartition(5)
    got = filter_audit.non_minimum(df, 4).collect()
    least = {}
    for _, t, _, i in rows:
        least[t] = min(least.get(t, i), i)
    expected = Counter((i, p, filter_audit.COPY * (i > least[t])) for _, t, p, i in rows)
    assert sum(n for *_, n in got) == len(rows)
    summed = Counter()
    for *tag, n in got:
        summed[tuple(tag)] += n
    assert summed == expected


def test_a_hot_text_moves_once_a_task(spark):
    """Of many copies a task passes one text on; the rest go as ids."""
    df = spark.range(20_000, numPartitions=4).selectExpr("1L as h", "id as doc_id", "'en' as part", "0 as mask", "repeat('copy ', 100) as text")
    sent = df.rdd.mapPartitions(filter_audit._least_of_task).map(lambda kv: kv[1][0] is not None).collect()
    assert sum(sent) <= 4 and len(sent) == 20_000
    documents = df.selectExpr("doc_id", "part as lang", "text")
    counts = {r.mask: r.n for r in masks(documents).groupBy("mask").sum("n").toDF("mask", "n").collect()}
    assert sum(counts.values()) == 20_000 and sum(n for m, n in counts.items() if not m & filter_audit.COPY) == 1
