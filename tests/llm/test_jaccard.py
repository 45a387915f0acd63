"""Components of similar documents against brute force over all pairs."""

import random
import re

from chronolith.llm import jaccard_groups
from chronolith.llm.jaccard_groups import jaccard_components

from .conftest import SCHEMA, prose


def brute(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.setdefault(i, set()).update({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    ids = sorted(i for i in sets if i is not None)
    low = {i: i for i in ids}
    moved = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in links:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low, {i: len(sets[i]) for i in ids}


def edited(text, r, share):
    w = text.split(" ")
    for _ in range(max(1, int(len(w) * share))):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_near_copies_at_all_distances(spark):
    r = random.Random(3)
    texts = []
    for seed in range(12):
        base = prose(seed, r.choice([6, 12, 40, 150]))
        texts += [base, base.upper(), edited(base, r, 0.01), edited(base, r, 0.02), edited(base, r, 0.03), edited(base, r, 0.05), base + " " + prose(seed + 900, len(base.split()) // 5)]
    hub = prose(77, 120)
    texts += [edited(hub, r, r.choice([0.01, 0.02, 0.03, 0.04])) for _ in range(60)] + [hub]
    passage = prose(78, 60)
    texts += [prose(1000 + k, 10) + " " + passage + " " + prose(2000 + k, 10) for k in range(30)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).toPandas().set_index("doc_id")
    low, n = brute(rows)
    assert got.component_id.to_dict() == low
    assert got.n_shingles.to_dict() == n


def test_chains_reach_the_smallest_id(spark):
    w = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(w[8 * k : 8 * k + 200])) for k in range(20)]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows)[0] and set(got.values()) == {81}


def test_odd_rows(spark, odd, none):
    got = jaccard_components(odd).toPandas()
    assert len(got) == odd.count()
    by = got.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")
    assert (by.loc[[4, 5, 6], "n_shingles"] == 0).all() and (by.loc[[4, 5, 6], "component_id"] == [4, 5, 6]).all()
    assert by.loc[2, "component_id"] == 1 and by.loc[3, "component_id"] == 1 and by.loc[7, "n_shingles"] == 1
    assert got[got.doc_id.isna()].component_id.isna().all()
    assert jaccard_components(none).count() == 0
    assert jaccard_components(spark.createDataFrame([(1, None)], SCHEMA.split(", lang")[0])).collect()[0].component_id == 1
    twice = spark.createDataFrame([(9, "one two three"), (3, "one two three"), (9, ""), (8, "")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(twice).collect()) == [(3, 1, 3), (8, 0, 8), (9, 0, 3), (9, 1, 3)]


def _counted(spark, monkeypatch, texts):
    """Components, and the rows of the three joins on shingles before any is grouped: between groups, and two inside one."""
    n = {}

    def counting(patch, name, rows=lambda out: out):
        real = getattr(jaccard_groups, name)

        def run(*args):
            out = real(*args)
            n[name] = rows(out).count()
            return out

        patch.setattr(jaccard_groups, name, run)

    with monkeypatch.context() as patch:
        counting(patch, "asked", lambda out: out[0])
        counting(patch, "rare_rows")
        counting(patch, "dense_rows")
        got = jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5))
        got = {r.doc_id: r.component_id for r in got.collect()}
    return got, n


def test_a_passage_in_all_documents_makes_no_pairs(spark, monkeypatch):
    passage = prose(5, 60)
    texts = [prose(10_000 + k, 20) + " " + passage + " " + prose(20_000 + k, 20) for k in range(2000)]
    got, n = _counted(spark, monkeypatch, texts)
    assert got == {i: i for i in range(2000)}
    assert sum(n.values()) < 20_000


def test_edited_copies_of_one_base_that_mostly_do_not_link(spark, monkeypatch):
    r = random.Random(8)
    base = prose(6, 100)
    texts = [edited(base, r, r.choice([0.01, 0.02, 0.03, 0.04, 0.05])) for _ in range(4000)]
    rows = {}
    for size in (1000, 4000):
        got, n = _counted(spark, monkeypatch, texts[:size])
        assert got == brute_fast(texts[:size])
        rows[size] = sum(n.values()) / size
    assert rows[4000] < 20 and rows[4000] < 2 * max(rows[1000], 5)


def brute_fast(texts):
    """Components of all links, with sets as bits."""
    import numpy as np

    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.lower().split(" ") for t in texts)]
    place = {s: i for i, s in enumerate(set().union(*sets))}
    common = np.zeros((len(texts), len(place)), np.float32)
    for i, s in enumerate(sets):
        common[i, [place[x] for x in s]] = 1
    n = common.sum(1)
    common = common @ common.T
    near = 100 * common >= 80 * (n[:, None] + n[None] - common)
    low = np.arange(len(texts))
    while True:
        new = np.array([low[row].min() for row in near])
        if (new == low).all():
            return dict(enumerate(low.tolist()))
        low = new
