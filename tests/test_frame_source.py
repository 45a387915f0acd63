"""The source of frames decodes what a query asks for, and no more."""

import json
import os
import tempfile

import pytest

from chronolith.sources import frame_source


@pytest.fixture
def asked(spark):
    """A frame of the source over two files of 100 and 45 seconds, and what its decoder was asked since the last look."""
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "counting_decoder.py"))
    frame_source.register(spark)
    spark.conf.set(frame_source.PUSHDOWN, "true")
    folders = {s: tempfile.mkdtemp(prefix="spark-media-") for s in ("a", "b")}
    media = spark.createDataFrame([("a", folders["a"], 100.0), ("b", folders["b"], 45.0)], "series string, path string, duration double")

    def look():
        out = []
        for s, folder in folders.items():
            for name in os.listdir(folder):
                with open(f"{folder}/{name}") as f:
                    out.append((s, *json.load(f)))
                os.remove(f"{folder}/{name}")
        return sorted(out)

    yield lambda **options: frame_source.frames(spark, media, "counting_decoder:decode", rangeSeconds="30", **options), look
    spark.conf.unset(frame_source.PUSHDOWN)


def test_every_range_once(asked):
    source, look = asked
    rows = source().collect()
    assert len(rows) == 400 + 180 and len({(r.series, r.i) for r in rows}) == 580
    assert look() == [("a", 0.0, 30.0, False, 120), ("a", 30.0, 60.0, False, 120), ("a", 60.0, 90.0, False, 120), ("a", 90.0, 100.0, False, 40), ("b", 0.0, 30.0, False, 120), ("b", 30.0, 45.0, False, 60)]
    assert source().rdd.getNumPartitions() == 6


@pytest.mark.parametrize(
    ("where", "calls", "n"),
    [
        ("t >= 40 and t < 50 and series = 'a'", [("a", 40.0, 50.0, False, 40)], 40),
        ("t > 40 and t <= 50 and series in ('a', 'z')", None, 40),
        ("t = 61.25", [("a", 61.25, 61.25, False, 1)], 1),
        ("keyframe and t < 30 and series = 'b'", [("b", 0.0, 30.0, True, 12)], 12),
        ("t >= 25 and t < 35", [("a", 25.0, 30.0, False, 20), ("a", 30.0, 35.0, False, 20), ("b", 25.0, 30.0, False, 20), ("b", 30.0, 35.0, False, 20)], 80),
        ("series = 'nobody'", [], 0), ("t >= 5000", [], 0), ("t < 1 and pixels[0] = 0.5 and series = 'a'", [("a", 0.0, 1.0, False, 4)], 1),
        ("not keyframe and t < 5 and series = 'b'", [("b", 0.0, 5.0, False, 20)], 18),
    ],
)
def test_filters_reach_the_decoder(asked, where, calls, n):
    source, look = asked
    assert source().filter(where).count() == n
    got = look()
    if calls is not None:
        assert [(s, a, pytest.approx(b), k, f) for s, a, b, k, f in calls] == got


def test_key_frames_by_option(asked):
    source, look = asked
    assert source(keyframes="true").count() == 40 + 18
    assert all(k for _, _, _, k, _ in look())


def test_the_setting_is_needed(spark, asked):
    source, _ = asked
    spark.conf.set(frame_source.PUSHDOWN, "false")
    with pytest.raises(Exception, match="filterPushdown"):
        source().collect()
