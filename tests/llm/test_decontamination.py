"""Winnowing against a search of every window in every text."""

import random
import re

from chronolith.llm.winnowing import contamination

from .conftest import prose


def brute(docs, items, span=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - span + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + span]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if (own := windows.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    found |= own
        out[d] = (len(w), len(hit), sorted(found))
    return out


def test_every_shared_span_is_found(spark):
    r = random.Random(4)
    items = [(k, prose(500 + k, r.choice([1, 3, 9, 10, 11, 25, 60]))) for k in range(40)] + [(40, ""), (41, None), (42, "... !!")]
    docs = []
    for d in range(120):
        w = prose(d, r.randint(0, 80)).split()
        for _ in range(r.randint(0, 3)):
            own = items[r.randrange(40)][1].split()
            a = r.randrange(len(own))
            at = r.randint(0, len(w))
            w[at:at] = own[a : a + r.choice([5, 9, 10, 12, 40])]
        docs.append((d, ("; " if d % 2 else " ").join(w).title() if d % 3 else " ".join(w)))
    got = contamination(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {x.doc_id: (x.n_words, x.n_hit, list(x.items)) for x in got.collect()} == brute(docs, items)


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two", 3), (2, None, 3), (None, prose(1, 60), 3)], "item_id bigint, text string, doc_id int")
    got = contamination(odd, bench).collect()
    assert len(got) == odd.count()
    by = {x.doc_id: x for x in got}
    assert by[7].contaminated and list(by[7].items) == ["1"] and by[7].n_hit == 2
    assert by[1].contaminated and list(by[1].items) == []
    assert not by[4].contaminated and by[4].n_words == 0
    assert contamination(none, bench).count() == 0
    assert not any(x.contaminated for x in contamination(odd, bench.limit(0)).collect())


def test_rows_of_one_id_and_of_none_are_judged_by_their_own_text(spark):
    item = prose(7, 30)
    docs = [(1, prose(1, 14) + " " + item), (1, item), (1, prose(2, 4)), (None, item), (None, prose(3, 20)), (None, None)]
    got = contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    key = lambda x: (x[0] or 0, x[1], x[2], x[3])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got), key=key) == sorted([(1, 44, 30, True), (1, 30, 30, True), (1, 4, 0, False), (None, 30, 30, True), (None, 20, 0, False), (None, 0, 0, False)], key=key)
