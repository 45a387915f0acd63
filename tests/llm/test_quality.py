"""Quality by lines and by trees: held-out accuracy, chains against enumeration, exact statistics, odd rows."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chronolith.llm import gbt_rules, quality_crf, queries

from .conftest import prose

SF01 = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.op1_quality_classifier(spark, SF01).toPandas()
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    both = got.merge(spark.read.parquet(f"{SF01}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.95


def test_chain_marginals_against_all_paths():
    r = np.random.default_rng(1)
    first = np.array([0, 3, 4, 4, 9])
    gain, moves = r.normal(size=9), r.normal(size=(2, 2))
    good, _, z = quality_crf.marginals(gain, first, moves)
    total = 0.0
    for a, b in itertools.pairwise(first):
        if a == b:
            continue
        weight = {s: np.exp(sum(gain[a + k] * x for k, x in enumerate(s)) + sum(moves[x, y] for x, y in itertools.pairwise(s))) for s in itertools.product((0, 1), repeat=int(b - a))}
        total += np.log(sum(weight.values()))
        for k in range(b - a):
            assert np.isclose(good[a + k], sum(w for s, w in weight.items() if s[k]) / sum(weight.values()))
    assert np.isclose(z, total)


def test_neighbours_count():
    """The same line is judged by the lines around it."""
    text = lambda lines: "\n".join(lines)
    good, bad = prose(3, 25) + ".", "### $$$ ||| %%% &&&"
    model = quality_crf.fit([text([good] * 6)] * 20 + [text([bad] * 6)] * 20, [1] * 20 + [0] * 20)
    score, n = quality_crf.score_texts(model, pa.array([text([good, good, "ok", good]), text([bad, bad, "ok", bad]), "", None]))
    assert score[0] > 0.5 > score[1] and score[2] < 0.5 and list(n) == [4, 4, 0, 0]


def test_odd_rows_crf(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (9, 0, 1), (11, 1, 0), (None, 1, 0), (3, None, 1)], "doc_id bigint, quality int, toxic int")
    texts, y, share = quality_crf.training_sample(odd, labels)
    assert sorted(y) == [0, 0, 1] and 0 < share < 1
    model = quality_crf.fit(texts, y, share, epochs=5)
    assert quality_crf.quality(odd, model).count() == odd.count()
    assert quality_crf.quality(none, model).count() == 0
    assert quality_crf.training_sample(none, labels) == ([], [], 0.5)
    assert {r.score for r in quality_crf.quality(odd, quality_crf.fit([], [])).collect()} == {0.5}


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {i + j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)]


def test_statistics_are_exact(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("text").toPandas().text.tolist()
    docs += [None, "", "\n\n", "a\na\n a\n\na ", "x x x x", "x y z x y z", "\n", "ß日 #*\x0b|<", "a\x1cb\x85c d"]
    got, _ = gbt_rules.statistics(pa.array(docs, pa.string()))
    assert got.tolist() == [plain_statistics(t) for t in docs]


def test_verdicts(spark):
    got = queries.op7_quality_rules(spark, SF01).toPandas()
    failed = (got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words)
    assert (got.base_failed == failed).all() and not got[got.base_failed].kept.any()
    both = got.merge(spark.read.parquet(f"{SF01}/labels.parquet").toPandas(), on="doc_id")
    own = both[~both.base_failed]
    assert (own.kept == (own.quality == 1)).mean() > 0.95


@pytest.mark.parametrize("seed", range(3))
def test_constraints_hold_everywhere(seed):
    r = np.random.default_rng(seed)
    x = r.random((400, 3))
    y = ((x[:, 0] + 0.5 * np.sin(9 * x[:, 0]) - x[:, 1] + 0.3 * r.normal(size=400)) > 0.3).astype(float)
    forest = gbt_rules.grow(x, y, {0: 1, 1: -1})
    grid = np.linspace(-0.2, 1.2, 60)
    for row in r.random((25, 3)):
        for j, sign in ((0, 1), (1, -1)):
            line = np.repeat(row[None], 60, axis=0)
            line[:, j] = grid
            assert (sign * np.diff(forest.raw_score(line)) >= -1e-12).all()
    assert ((forest.raw_score(x) > 0) == (y == 1)).mean() > 0.8


def test_odd_rows_rules(odd, none):
    forest = gbt_rules.fit([], [])
    got = gbt_rules.apply_rules(odd, forest).collect()
    assert len(got) == odd.count()
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (4, 5, 6))
    assert gbt_rules.apply_rules(none, forest).count() == 0
