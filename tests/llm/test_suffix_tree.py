"""The suffix tree against a plain version that counts everything in dictionaries."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import suffix_tree
from chronolith.llm.storage import crc_rest

from .conftest import prose

LOWER = {c: c + 32 for c in range(65, 91)}
RARE, START, END = "<rare>", "<start>", "<end>"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), END]


def brute(train, texts, gain, depth, room):
    """Tokens, known ones, base and score of each text; kept contexts of each length."""
    seqs = [tokens(t) for t in train]
    c1 = Counter(w for s in seqs for w in s)
    n, v = sum(c1.values()), len(c1)
    once, twice = (sum(x == k for x in c1.values()) for k in (1, 2))
    lost = min(0.9, max(0.1, once / (once + 2 * twice)))
    step = lambda w: math.floor(math.log2(c1[w]) * suffix_tree.STEPS)
    words = sorted((w for w in c1 if w != END), key=step, reverse=True)
    least = None
    for s in sorted({step(w) for w in words}, reverse=True):
        if sum(step(w) >= s for w in words) > room:
            break
        least = s
    inside = {END} | {w for w in words if least is not None and step(w) >= least}
    code = lambda w: w if w in inside else RARE
    root = {w: (c1[w] - lost) / n for w in inside}
    root[RARE] = 1 - sum(root.values())
    d, levels = suffix_tree.DISCOUNT, []

    def p(context, w):
        for k in range(min(len(context), len(levels)), 0, -1):
            state = levels[k - 1].get(context[-k:])
            if state:
                return state[1].get(w, 0) + state[0] * p(context[len(context) - k + 1 :], w)
        return root[w]

    coded = [[START, *map(code, s)] for s in seqs]
    for k in range(1, depth + 1):
        by = defaultdict(Counter)
        for s in coded:
            for i in range(k, len(s)):
                by[tuple(s[i - k : i])][s[i]] += 1
        kept = {}
        for context, nxt in by.items():
            size, nxt = sum(nxt.values()), {w: c for w, c in nxt.items() if c >= 2}
            if nxt:
                rest = 1 - sum(c - d for c in nxt.values()) / size
                below = {w: p(context[1:], w) for w in nxt}
                won = sum(c * math.log(((c - 1 - d) / (size - 1) + rest * below[w]) / below[w]) for w, c in nxt.items())
                if won + (size - sum(nxt.values())) * math.log(rest) >= gain:
                    kept[context] = (rest, {w: (c - d) / size for w, c in nxt.items()})
        levels.append(kept)

    def scored(t):
        s = tokens(t)
        cs, total = [START, *map(code, s)], 0.0
        for i, w in enumerate(s):
            total += math.log10(p(tuple(cs[max(0, i + 1 - depth) : i + 1]), cs[i + 1]))
            if cs[i + 1] == RARE:
                total += math.log10((c1[w] - lost if c1[w] else min(lost * v, (1 - lost) / 2)) / (n * root[RARE]))
        return len(s), sum(c1[w] > 0 for w in s), sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in s), total

    return [scored(t) for t in texts], [len(x) for x in levels]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    follows, texts = {}, []
    for _ in range(20):
        said = ["a", "b", "c", "a"]
        for _ in range(200):
            said.append(follows.setdefault(tuple(said[-3:]), r.choice("abc")) if r.random() < 0.9 else r.choice("abc"))
        texts.append(" ".join(said))
    line = prose(50, 30)
    return texts + [prose(k, r.randint(1, 60)) + (" " + line if k % 3 == 0 else "") for k in range(60)] + ["once rare pair", "twice rare pair", "tiny", "tiny", None, "", "A"]


@pytest.mark.parametrize(("depth", "bits", "share", "hot"), [(3, 16, suffix_tree.HEAD_SHARE, 250_000), (2, 5, 2.0, 40), (3, 6, 0.004, 100), (4, 16, 2.0, 250_000)])
def test_same_scores_as_counting_everything(spark, corpus, depth, bits, share, hot):
    """Also with few words in the alphabet, with values from buckets and not from the head, and with frequent contexts split."""
    train = spark.createDataFrame([(t,) for t in corpus], "text string").repartition(3)
    tree = suffix_tree.fit(train, gain=4.0, depth=depth, most_bits=bits, hot_tokens=hot)
    unseen = [*corpus[::7], "never seen zzz of the", prose(50, 30) + " zzz", "rare pair of a b c a b", None, ""]
    want, kept = brute(corpus, unseen, 4.0, depth, (1 << min(bits, 64 // (depth + 1))) - suffix_tree.FIRST)
    assert [tree.kept(k + 1) for k in range(depth)] == kept and all(kept[:3])
    got = {r.doc_id: r for r in suffix_tree.score(spark.createDataFrame(list(enumerate(unseen)), "doc_id bigint, text string"), tree, share).collect()}
    for i, (n, known, base, score) in enumerate(want):
        assert (got[i].n_tokens, got[i].n_known) == (n, known)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and math.isclose(got[i].score, score, rel_tol=1e-9)


def test_odd_rows(odd, none):
    tree = suffix_tree.fit(odd)
    got = suffix_tree.score(odd, tree).collect()
    assert len(got) == odd.count()
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (4, 5, 6))
    assert suffix_tree.score(none, tree).count() == 0
    blank = suffix_tree.score(odd, suffix_tree.fit(none)).collect()
    assert all(r.n_known == 0 and r.score == 0 and r.base_score == 0 for r in blank)


def test_two_occurrences_are_enough(spark):
    """A context seen twice with one rare follower gains over GAIN, and is kept."""
    texts = [prose(k, 60) for k in range(100)] + ["qqq zzz", "qqq zzz"]
    tree = suffix_tree.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    score = {r.doc_id: r.score for r in suffix_tree.score(spark.createDataFrame([(1, "qqq zzz"), (2, "zzz qqq")], "doc_id bigint, text string"), tree).collect()}
    assert score[1] > score[2] + 2


def test_invented_words_are_the_least_likely_and_contexts_help(spark):
    """On sf0.01: 50 invented words lie below every held-out text, a token; held-out texts are likelier than by their words alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held_out = docs.filter(crc_rest(F.col("doc_id"), 7) == 2)
    tree = suffix_tree.fit(docs.filter(crc_rest(F.col("doc_id"), 7) != 2))
    invented = spark.createDataFrame([(-1, " ".join(f"q{k}zx{k}v" for k in range(50)))], "doc_id bigint, text string")
    got = suffix_tree.score(held_out.unionByName(invented), tree).toPandas()
    rate = (got.score / got.n_tokens).set_axis(got.doc_id)
    assert rate[-1] < rate.drop(-1).min()
    real = got[got.doc_id >= 0]
    assert real.score.sum() > real.base_score.sum()


def test_words_are_told_apart_by_eights():
    """Equal words have equal hashes wherever they stand, others do not: ends of eight bytes, NUL, long words."""
    import pyarrow as pa
    from chronolith.llm import textarrays

    words = ["a", "a\x00", "\x00a", "\x00", "abcdefgh", "abcdefghi", "abcdefgh\x00", "ihgfedcba", "é" * 8, "x" * 256, "x" * 257, "x" * 300 + "y", "x" * 300 + "z"]
    texts = pa.array([" ".join(words), None, "", "\t".join(reversed(words)), *words])
    w = textarrays.words_of(texts, hashed=False)
    hashes = textarrays.hashed_by_eights(w)
    of = {}
    for s, e, h in zip(w.start, w.end, hashes, strict=True):
        of.setdefault(w.data[s:e].tobytes(), set()).add(int(h))
    assert len(of) == len(words) and all(len(h) == 1 for h in of.values()) and len(set.union(*of.values())) == len(words)


def test_windows_of_a_level_share_one_exchange(spark):
    """Entries are dealt by context and sorted once (three exchanges before)."""
    entries = spark.createDataFrame([(k << 4 | j, 5, 20, 0.01) for k in range(1, 9) for j in (4, 5)], "key bigint, c bigint, n bigint, below double")
    level = suffix_tree.divergent(entries, 4, 1.0)
    plan = level._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and level.count() == 16


def test_codes_are_looked_up_where_hashes_collide():
    """Hashes of equal low bits, the one behind the last place, unknown ones and 0; a small alphabet and none."""
    r = np.random.default_rng(1)
    near = np.concatenate([np.arange(1, 40, dtype=np.uint64) << np.uint64(40), np.full(1, (1 << 64) - 1, np.uint64), r.integers(1, 1 << 63, 500, dtype=np.uint64)])
    for keys in (np.unique(near), near[:2], near[:0]):
        names = suffix_tree.Alphabet(16, keys, np.arange(len(keys), dtype=np.uint64) + np.uint64(suffix_tree.STOP), np.zeros(0))
        wanted = np.concatenate([near, np.arange(3, dtype=np.uint64), r.integers(1, 1 << 63, 500, dtype=np.uint64)])
        codes = {int(k): i + suffix_tree.STOP for i, k in enumerate(keys)}
        assert names.coded(wanted).tolist() == [codes.get(int(h), suffix_tree.RARE) for h in wanted]
        assert len(names.placed) >= 4 * len(keys)
