"""Value tables of the scalar and text functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from chronolith.functions import scalars as S
from chronolith.functions import text as T


def values(spark, rows, schema, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_token_cost(spark):
    table = [(1000, 1000, 1296), (1092, 1092, 1521), (1456, 819, 1560), (1920, 1080, 2691), (2576, 1449, 4784), (1269, 952, 1564), (640, 360, 299), (960, 540, 700), (1280, 720, 1196)]
    assert values(spark, table, "w int, h int, n int", S.image_tokens(F.col("w"), F.col("h"))) == [n for _, _, n in table]
    assert values(spark, [(1920, 1080)], "w int, h int", S.fit_to_tier(F.col("w"), F.col("h"))[1], S.fit_to_tier(F.col("w"), F.col("h"), True)[1]) == [(882, 1080)]
    with pytest.raises(Exception, match="positive"):
        values(spark, [(0, 5)], "w int, h int", S.image_tokens(F.col("w"), F.col("h")))
    assert values(spark, [(1920, 1080, 1280), (1000, 5, 100), (640, 361, 640)], "a int, b int, w int", S.scaled_height(F.col("a"), F.col("b"), F.col("w"))) == [720, 2, 360]
    plan = values(spark, [(10, 1280, 1920, 1080)], "n int, w int, a int, b int", S.budget_plan(F.col("n"), F.col("w"), F.col("a"), F.col("b")))[0]
    assert (plan.tokens, plan.tokens_all, plan.tokens_call) == (1196, 11960, 9568)


def test_time_codes(spark):
    table = [(252.0, "4:12.0", "4:12"), (3852.0, "1:04:12.0", "1:04:12"), (7.25, "0:07.2", "0:07"), (-3.0, "-0:03.0", "0:57"), (None, "?", None), (0.5, "0:00.5", "0:00"), (1.5, "0:01.5", "0:02")]
    got = values(spark, [(s,) for s, _, _ in table], "s double", S.timecode(F.col("s")), S.timecode_short(F.col("s")))
    for (s, long, short), (a, b) in zip(table, got, strict=True):
        assert a == long
        if s is None or s >= 0:
            assert b == short
    read = [("4:12", 252.0), ("1:04:12", 3852.0), ("252", 252.0), ("252.5", 252.5), ("0:07", 7.0), (" 1:2 ", 62.0), ("4:12:33:44", None), ("soon", None), ("", None), (None, None)]
    assert values(spark, [(v,) for v, _ in read], "v string", S.parse_timecode(F.col("v"))) == [x for _, x in read]
    with pytest.raises(Exception, match="not a time code"):
        values(spark, [("soon",)], "v string", S.parse_timecode(F.col("v"), strict=True))


def test_budgets(spark):
    assert values(spark, [(60.0,), (2312.0,), (10800.0,)], "s double", S.moment_budget(F.col("s"))) == [40, 231, 600]
    assert values(spark, [(14.0,), (6.0,), (120.0,), (179.0,), (180.0,)], "s double", S.gap_target(F.col("s"), 15.0)) == [14 / 12, 1.0, 10.0, 179 / 12, 15.0]


def test_links_and_names(spark):
    rows = [("https://youtu.be/x", 9.9), ("https://youtube.com/watch?v=1", 61.0), ("/a/b.mp4", 3.2), (None, 3.0)]
    assert values(spark, rows, "u string, t double", S.moment_link(F.col("u"), F.col("t"))) == ["https://youtu.be/x?t=9", "https://youtube.com/watch?v=1&t=61", "/a/b.mp4#t=3", "#t=3"]
    names = [("Hello,  World_x!", "hello-world-x"), ("Привет мир", "привет-мир"), ("!!!", "video"), ("ﬁne", "fine"), ("a" * 59 + " bc", "a" * 59), (" -x- ", "x")]
    assert values(spark, [(a,) for a, _ in names], "x string", S.slug(F.col("x"))) == [b for _, b in names]
    ids = [("https://h.example/embed/1234567?x", "1234567"), ("https://h.example/0A0b0c0d-0000-4000-8000-000000000001", "0a0b0c0d-0000-4000-8000-000000000001"), ("https://h.example/a/b", None)]
    assert values(spark, [(a,) for a, _ in ids], "u string", T.video_id(F.col("u"))) == [b for _, b in ids]
    hosts = [("https://v.example/1234567", "1234567"), ("https://a.v.example:80/1234567", "1234567"), ("v.example/1234567", "1234567"), ("https://other.example/1234567", None), ("https://notv.example/1234567", None), ("https://other.example/v.example/1234567", None)]
    assert values(spark, [(a,) for a, _ in hosts], "u string", T.video_id(F.col("u"), "v.example")) == [b for _, b in hosts]
    signs = [("x?expires=1&sign=AB&sign=C", "expires=1&sign=AB"), (r"x?expires=1&sign=Z", "expires=1&sign=Z"), ("x?a=1", ""), (None, ""), (r"Token=фq", r"token=фq")]
    assert values(spark, [(a,) for a, _ in signs], "u string", T.link_signature(F.col("u"))) == [b for _, b in signs]


def test_rates_and_durations(spark):
    rates = [("30000/1001", 30000 / 1001), ("25", 25.0), ("0/0", 0.0), ("N/A", 0.0), (None, 0.0), ("5/0", 0.0), ("a/b", 0.0)]
    assert values(spark, [(a,) for a, _ in rates], "x string", S.ratio(F.col("x"))) == [b for _, b in rates]
    assert values(spark, [(30.0, 30.0), (30.0, 29.0), (0.0, 0.0)], "a double, b double", S.variable_rate(F.col("a"), F.col("b"))) == [False, True, False]
    times = [("PT1H22M49.364S", 4969.364), ("PT5M", 300.0), ("P2DT1S", 1.0), ("", 0.0), ("soon", 0.0)]
    assert values(spark, [(a,) for a, _ in times], "x string", S.iso_duration(F.col("x"))) == pytest.approx([b for _, b in times])
    versions = [("2026.01.02", True), ("2026.06.01", False), ("main", False), (None, False)]
    assert values(spark, [(a,) for a, _ in versions], "x string", S.is_stale(F.col("x"), F.lit(datetime.date(2026, 7, 1)))) == [b for _, b in versions]


def test_ranges_and_ladders(spark):
    got = values(spark, [(0, 70), (40, 70), (90, 70), (70, 70)], "done bigint, size bigint", S.range_plan(F.col("done"), F.col("size"), 32))
    assert [[tuple(x) for x in r] for r in got] == [[(0, 31), (32, 63), (64, 69)], [(40, 69)], [(0, 31), (32, 63), (64, 69)], []]
    assert values(spark, [(1080,), (480,)], "h int", S.video_formats(F.col("h")))[1] == ["bv*[height<=480][ext=mp4]", "bv*[height<=480]", "b[height<=480]", "b[height<=360]"]
    assert [(r.client, r.wait) for r in S.retry_schedule(spark).orderBy("attempt").take(5)] == [("default", 0), ("default", 5), ("default", 15), ("default", 45), ("android", 0)]


def test_folding_and_quotes(spark):
    rows = [("  Ёлка  И\nЕль ",)]
    assert values(spark, rows, "x string", T.normalized(F.col("x"))) == ["елка и ель"]
    cases = [("run main now", "please RUN  main now", True), ("alpha beta gamma delta epsilon", "alpha beta gamma xx", True), ("alpha beta gamma delta", "alpha beta", False), ("zz", "other text", True), ("zz yy", "", False), ("zz yy", None, False)]
    assert values(spark, [c[:2] for c in cases], "q string, h string", T.quote_supported(F.col("q"), F.col("h"))) == [c[2] for c in cases]
    assert values(spark, [("say «first one» and `code x` or \"two\"",)], "x string", T.quotes(F.col("x"))) == [["first one", "code x", "two"]]
    assert values(spark, [("  - **done** — [4:12 / f0043]",)], "x string", T.claim_text(F.col("x"))) == ["**done**"]
    assert values(spark, [("&lt;b&gt;x&lt;/b&gt; &amp; <i>y</i>",)], "x string", T.bare_text(F.col("x"))) == ["x & y"]


def test_closed_entities(spark):
    given = [("a &amp<p>b &am</p>",), ("&copy; &#65;&#x42; &amp;lt; &notit; &unknown;",), (None,)]
    assert values(spark, given, "x string", T.bare_text(F.col("x"), closed=True)) == ["a &ampb &am", "© AB &lt; &notit; &unknown;", None]
    assert values(spark, given[:1], "x string", T.bare_text(F.col("x"))) == ["a &b &am"]
