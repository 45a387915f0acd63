"""Secret scans: base spans against plain regular expressions, the model's own finds, redaction, odd rows."""

import hashlib
import itertools
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from chronolith.llm import queries, secret_crf

from .conftest import prose

SF01 = "/root/testdata/sf0.01"


def plain_spans(text):
    out = []
    for m in re.finditer(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or ""):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    for order, kind, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 18), (2, "hex", r"[0-9a-f]+", 16)):
        out += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text or "") if m.end() - m.start() >= least]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def test_base_spans_are_exact(spark):
    got = queries.op6_secret_scans(spark, SF01).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF01}/documents.parquet").toPandas()
    assert len(got) == len(docs)
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        base = plain_spans(text)
        assert got.base_sha256[i] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in got.spans[i].split(",") if s and not s.startswith("crf")] == base
        assert [got[f"n_{k}"][i] for k in ("assign", "access", "hex")] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]


def test_tricky_base_spans():
    texts = [
        "ToKen='abcdefghijkl'", "token = abcdefghijk", "ſecret: abcdefghijklmno secret:abcdefghijklmno", "ſecret: abcdefghijklmno", "to\u212aen: abcdefghijklmno", "api_\u212aey=abcdefghijklmno", "xAKIA" + "Z" * 13 + "AKIA" + "A" * 14, "ä日password:  \"AAAAbbbbCCCC1", "deadbeefdeadbeef0 DEADBEEFDEADBEEF",
        "api_key=api_key=abcdefghijklmnop", "apikey\":\"x.y-z_0123456789==", "f" * 15, "token\n=abcdefghijklmnop", "passwd:passwd:passwd:passwd1234", None, "",
    ]
    model = secret_crf.fit([])
    got = secret_crf.scan_texts(model, pa.array(texts, pa.string()))
    assert [[f"{secret_crf.KINDS[k]}:{a}:{b}" for a, b, k in spans] for spans in got] == [plain_spans(t) for t in texts]
    for t in texts:  # no text can hide in another's
        assert [[f"{secret_crf.KINDS[k]}:{a}:{b}" for a, b, k in spans] for spans in secret_crf.scan_texts(model, pa.array([t], pa.string()))] == [plain_spans(t)]


def test_the_model_adds_secrets_it_was_not_told_of(spark):
    r = np.random.default_rng(5)
    key = lambda n: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), n))
    train = [f"{prose(k, 30)}\ntoken = {key(32)}\n{prose(k + 99, 30)}" for k in range(60)] + [prose(k + 500, 60) for k in range(60)]
    model = secret_crf.fit(train)
    hidden = key(32)
    text = f"{prose(900, 20)} token {hidden} {prose(901, 20)}"
    (spans,) = secret_crf.scan_texts(model, pa.array([text]))
    assert [(text[a:b], secret_crf.KINDS[k]) for a, b, k in spans] == [(hidden, "crf")]
    clean = secret_crf.scan_texts(model, pa.array([prose(k + 2000, 80) for k in range(50)]))
    assert not any(clean)


NO_SECRETS = [
    "https://docs.example.org/3/library/multiprocessing.shared_memory.html", "AbstractSingletonProxyFactoryBean", "org.example.engine.sql.expressions.Add", "2024-01-31T10:22:33.123Z", "very_long_function_name_with_many_parts",
    "INTERNATIONALIZATION", "antidisestablishmentarianism", "state-of-the-art-2019-benchmark", "/usr/share/python3/dist-packages/apt", "someone.name@mail.example.com", "152.143.123.131:8080",
]


def test_precision_and_recall_of_planted_secrets(spark):
    """Learned from base matches of sf0.01: keys that no base pattern matches, half behind no name, among words; none in clean words and look-alikes."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = secret_crf.fit(secret_crf.training_sample(docs))
    r = np.random.default_rng(11)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    for alphabet, size in ((letters, 32), (letters[26:], 32), ("0123456789ABCDEF", 40), (letters + "_-", 48)):
        keys = ["".join(r.choice(list(alphabet), size)) for _ in range(300)]
        keys = ["a" + k[1:-1] + "b" if alphabet == letters + "_-" else k for k in keys]
        texts = [f"{prose(k, 40)}{' token ' if k % 2 else ' '}{key} {prose(k + 5000, 40)}" for k, key in enumerate(keys)]
        clear = [not plain_spans(t) for t in texts]
        found = [{t[a:b] for a, b, k in spans if k == 3} for t, spans in zip(texts, secret_crf.scan_texts(model, pa.array(texts)), strict=True)]
        right = sum(key in f for key, f, c in zip(keys, found, clear, strict=True) if c)
        told = sum(len(f) for f, c in zip(found, clear, strict=True) if c)
        print("planted", right, "of", sum(clear), "spans told", told)
        assert right > 0.9 * sum(clear) and right > 0.95 * told
    assert not any(secret_crf.scan_texts(model, pa.array([prose(k + 9000, 200) for k in range(200)])))
    assert not any(secret_crf.scan_texts(model, pa.array([f"{prose(k, 9)} {x} {prose(k + 50, 9)}" for k, x in enumerate(NO_SECRETS)])))


def plain_features(text):
    """Features of the words of one text, told word by word."""
    data = text.encode()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    share = lambda x, kind: len(re.findall(kind, x))
    own = []
    cues = [m.start() for c in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key") for m in re.finditer(c, data.lower())]
    for a, b in words:
        x, n = data[a:b], b - a
        digit, upper, lower, join = (share(x, k) for k in (rb"[0-9]", rb"[A-Z]", rb"[a-z]", rb"[+/_=.-]"))
        other, kinds, vowels = n - digit - upper - lower - join, sum(k > 0 for k in (digit, upper, lower, join)), share(x, rb"[AEIOUaeiou]")
        changes, cases = (sum(p != q for p, q in itertools.pairwise([False, *(bool(re.match(k, bytes([c]))) for c in x)])) for k in (rb"[0-9]", rb"[A-Z]"))
        long = n >= 16
        own.append([
            min(n, 64) / 16, n >= 12, n >= 20, digit / n, upper / n, join / n, other / n, share(x, rb"[0-9a-f]") / n, digit >= 3 and long, kinds >= 2 and long, kinds >= 3 and long, min(changes, 16) / 8,
            any(a <= c < b for c in cues), x[-1:] in b":=", long and digit / n > 0.15, min(cases, 16) / 8, vowels / n, long and changes + cases >= n / 4, long and vowels <= n / 4 and not other, join > 0 and digit + join == n,
        ])
    none = [[0.0] * 5]
    side = [[o[k] for k in (0, 3, 12, 13, 14)] for o in own]
    size = sum(b - a for a, b in words) or 1
    by_file = [np.log1p(len(words)) / 8, share(data, rb"[0-9]") / size, any(o[12] for o in own), 1.0]
    return words, np.array([[*o, *p, *q, *by_file] for o, p, q in zip(own, none + side[:-1], side[1:] + none)], float).reshape(-1, secret_crf.N_FEATURES)


def plain_scan(model, text):
    """Base spans, and the runs of the best of all paths of each line that touch none of them."""
    words, x = plain_features(text)
    base = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in plain_spans(text)]
    data, out = text.encode(), list(base)
    for _, line in itertools.groupby(range(len(words)), key=lambda i: data[: words[i][0]].count(b"\n")):
        line = list(line)
        emit = x[line] @ model.weights
        paths = (p for p in itertools.product(range(3), repeat=len(line)) if p[0] != 2)
        best = max(paths, key=lambda p: sum(emit[k, s] for k, s in enumerate(p)) + sum(model.moves[s] for s in itertools.pairwise(p)))
        for run in re.finditer("12*", "".join(map(str, best))):
            ends = []
            for k in (run.start(), run.end() - 1):
                a, b = words[line[k]]
                parts = sorted(((m.start() - m.end(), m.start(), m.end()) for m in re.finditer(rb"[A-Za-z0-9+/_.=-]+", data[a:b])), key=lambda s: s[:2]) or [(0, 0, b - a)]
                ends.append((a + parts[0][1], a + parts[0][2]))
            a, b = (len(data[:k].decode()) for k in (ends[0][0], ends[1][1]))
            if not any(a < y and s < b for _, s, y in base):
                out.append(("crf", a, b))
    return sorted(out, key=lambda s: (s[1], secret_crf.KINDS.index(s[0])))


def test_features_and_whole_spans_against_plain_loops(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = secret_crf.fit(secret_crf.training_sample(docs))
    r = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    key = lambda n: "".join(r.choice(letters, n))
    mixes = [lambda: key(32), lambda: f'"{key(24)}",', lambda: "token =", lambda: "password=" + key(13), lambda: "ab12" * 5, lambda: "über", lambda: "日本" + key(20), lambda: "x" * 3, lambda: NO_SECRETS[r.integers(len(NO_SECRETS))], lambda: key(18) + " " + key(18), lambda: "AKIA" + "Q7" * 9]
    texts = ["\n".join(" ".join(mixes[k]() for k in r.integers(len(mixes), size=r.integers(0, 5))) for _ in range(4)) for _ in range(60)] + ["", " \n", "\n\nä", key(40)]
    assert any(s[0] == "crf" for t in texts for s in plain_scan(model, t))
    w = secret_crf.words_of(pa.array(texts), case=secret_crf.SAME, hashed=False)
    raw, w.data = w.data, secret_crf.LOWER[w.data]
    assert np.allclose(secret_crf.word_features(w, raw), np.concatenate([plain_features(t)[1] for t in texts]), atol=1e-5)
    got = secret_crf.scan_texts(model, pa.array(texts))
    assert [[(secret_crf.KINDS[k], a, b) for a, b, k in spans] for spans in got] == [plain_scan(model, t) for t in texts]


def test_marginals_against_all_paths():
    r = np.random.default_rng(7)
    first = np.array([0, 4, 5, 9])
    emit, moves = 3 * r.normal(size=(9, 3)), r.normal(size=(3, 3)) + secret_crf._BANNED
    p, pair = np.zeros((9, 3)), np.zeros((3, 3))
    for a, b in itertools.pairwise(first):
        paths = [q for q in itertools.product(range(3), repeat=int(b - a)) if q[0] != 2]
        mass = np.exp([sum(emit[a + k, x] for k, x in enumerate(q)) + sum(moves[m] for m in itertools.pairwise(q)) for q in paths])
        for q, m in zip(paths, mass / mass.sum(), strict=True):
            for k, x in enumerate(q):
                p[a + k, x] += m
            for m2 in itertools.pairwise(q):
                pair[m2] += m
    got, got_pair = secret_crf._marginals(emit, first, moves)
    assert np.allclose(got, p) and np.allclose(got_pair, pair)


def test_many_spans_in_one_text():
    """Spans of one text are told apart by search, not by looking at all others."""
    model = secret_crf.Model(np.zeros((secret_crf.N_FEATURES, 3)), secret_crf._BANNED.copy())
    model.weights[:, 1] = 1.0 * (np.arange(secret_crf.N_FEATURES) == secret_crf.N_FEATURES - 1)
    text = " ".join(f"{i:016x}" if i % 2 else f"w{i}é" for i in range(40_000))
    (spans,) = secret_crf.scan_texts(model, pa.array([text]))
    assert len(spans) == 40_000 and sum(k == 2 for _, _, k in spans) == 20_000
    assert [text[a:b] for a, b, k in spans[:4]] == ["w0", "0000000000000001", "w2", "0000000000000003"]


def test_viterbi_against_all_paths():
    r = np.random.default_rng(2)
    first = np.array([0, 4, 5, 9])
    emit, moves = r.normal(size=(9, 3)), r.normal(size=(3, 3)) + secret_crf._BANNED
    tags = secret_crf.viterbi(emit, first, moves)
    for a, b in itertools.pairwise(first):
        paths = [p for p in itertools.product(range(3), repeat=int(b - a)) if p[0] != 2]
        best = max(paths, key=lambda p: sum(emit[a + k, x] for k, x in enumerate(p)) + sum(moves[x, y] for x, y in itertools.pairwise(p)))
        assert tuple(tags[a:b]) == best


def test_redaction():
    assert secret_crf._redacted("ab secret cd", [(3, 9, 0), (5, 9, 2)], "[x]") == "ab [x] cd"
    assert secret_crf._redacted("abcdef", [(0, 2, 0), (1, 4, 2), (4, 6, 1)], "#") == "##"


def test_odd_rows(odd, none):
    model = secret_crf.fit(secret_crf.training_sample(odd))
    got = secret_crf.scan(odd, model).collect()
    assert len(got) == odd.count() and all(r.spans == [] for r in got if r.doc_id in (4, 5, 6, 7))
    assert secret_crf.scan(none, model).count() == 0 and secret_crf.training_sample(none) == []
    clean = secret_crf.redact(odd, model, "[x]")
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert clean.filter("doc_id = 4").first().text is None


def test_tasks_hold_little_beside_their_rows():
    """Rows of 4 MB, as a task gets them, are redacted in under 64 MB (164 when slices had 2 MB, 40 since)."""
    from types import SimpleNamespace

    texts = pa.array([prose(k, 3000) for k in range(240)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(240)), texts], names=["doc_id", "text"])
    task = SimpleNamespace(schema=None, mapInArrow=lambda run, schema: run, sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))))
    run = secret_crf.redact(task, secret_crf.fit([]), "[secret]")
    tracemalloc.start()
    rows = sum(part.num_rows for part in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 240 and texts.nbytes > 3 << 20 and peak < 64 << 20
