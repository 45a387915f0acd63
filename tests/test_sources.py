"""Captions, manifests and media probes on small inline files."""

import json

import pytest
from pyspark.sql import functions as F

from chronolith.sources import captions, manifests, media


def one(spark, raw, **more):
    return spark.createDataFrame([("s", raw, *more.values())], "series string, raw string" + "".join(f", {k} string" for k in more))


def lines(df):
    return [(r.t0_ms, r.t1_ms, r.text) for r in df.orderBy("i").collect()]


def test_json3_merges_rolling_lines(spark):
    events = [{"tStartMs": 0, "dDurationMs": 1000, "segs": [{"utf8": "hello "}, {"utf8": "big\nworld"}]}, {"tStartMs": 900}, {"tStartMs": 1000, "dDurationMs": 500, "segs": [{"utf8": "\n"}]},
              {"tStartMs": 1000, "dDurationMs": 2000, "segs": [{"utf8": "hello big world again"}]}, {"tStartMs": 2500, "dDurationMs": 100, "segs": [{"utf8": "hello big world again"}]}, {"tStartMs": 4000, "dDurationMs": 1, "segs": [{}, {"utf8": "new"}]}]
    assert lines(captions.json3_segments(one(spark, json.dumps({"events": events})))) == [(0, 3000, "hello big world again"), (4000, 4001, "new")]


def test_vtt_and_srt(spark):
    vtt = "WEBVTT\nKind: captions\n\n00:00:01.000 --> 00:00:02.50 align:start\n<c>Hi</c> &amp; bye\n&lt;i&gt;gone\n\nNOTE skip\n\n00:03.000 --> 00:04.000\nshort form\n\n00:00:05,1 --> x\nlast\n"
    assert lines(captions.vtt_segments(one(spark, vtt))) == [(1000, 2500, "Hi & bye gone"), (5100, 5100, "last")]
    assert lines(captions.vtt_segments(one(spark, vtt), strict=False))[1] == (3000, 4000, "short form")
    srt = "1\r\n00:00:01,000 --> 00:00:02,000\r\nOne\r\n42\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\nTwo\r\nlines\r\n"
    assert lines(captions.vtt_segments(one(spark, srt))) == [(1000, 2000, "One"), (3000, 4000, "Two lines")]
    assert one(spark, "x").select(captions.is_json3(F.lit("a.json3"), F.lit("")), captions.is_json3(F.lit("a"), F.lit("  {")), captions.is_json3(F.lit("a.vtt"), F.lit("WEBVTT"))).first() == (True, True, False)


MPD = """<?xml version="1.0"?><MPD xmlns="urn:mpeg:dash:schema:mpd:2011" mediaPresentationDuration="PT1M2.5S"><Period>
<AdaptationSet mimeType="video/mp4"><Representation codecs="avc1" height="720" bandwidth="900"><BaseURL> https://h/v/ </BaseURL><SegmentList>
<SegmentURL media="0/100/v.mp4?q=1"/><SegmentURL media="100/250/v.mp4?q=1"/><SegmentURL media="bad"/></SegmentList></Representation>
<Representation height="360" bandwidth="300"><BaseURL>https://h/w/</BaseURL><SegmentList><SegmentURL media="0/90/w.mp4"/></SegmentList></Representation>
<Representation height="1" bandwidth="1"><BaseURL></BaseURL></Representation></AdaptationSet>
<AdaptationSet mimeType="audio/mp4"><Representation bandwidth="64"><BaseURL>https://h/a.mp4</BaseURL><SegmentList>
<SegmentURL mediaRange="0-49"/><SegmentURL mediaRange="50-99"/></SegmentList></Representation></AdaptationSet></Period></MPD>"""


def test_dash_tracks(spark):
    got = {r.url: r for r in manifests.dash_tracks(one(spark, MPD)).collect()}
    assert {(r.kind, u, r.size, r.height) for u, r in got.items()} == {("video", "https://h/v/0/250/v.mp4?q=1", 250, 720), ("video", "https://h/w/0/90/w.mp4", 90, 360), ("audio", "https://h/a.mp4", 100, 0)}
    assert {r.duration for r in got.values()} == {62.5}
    tracks = manifests.dash_tracks(one(spark, MPD))
    assert [manifests.pick_video(tracks, h).first().height for h in (1080, 500, 100)] == [720, 360, 720]
    assert manifests.pick_audio(tracks).first().size == 100
    closed = MPD.replace("<Representation codecs", "<ContentProtection/><Representation codecs")
    assert manifests.dash_tracks(one(spark, closed), strict=False).count() == 0
    with pytest.raises(Exception, match="encrypted"):
        manifests.dash_tracks(one(spark, closed)).collect()


def test_hls_subtitles(spark):
    raw = '#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,URI="a"\n#EXT-X-MEDIA:TYPE=SUBTITLES,LANGUAGE="RU",NAME="Russian (Автоматические), x",URI="m.m3u8?id=1"\n#EXT-X-MEDIA:TYPE=SUBTITLES,LANGUAGE="ru",NAME="Russian",URI="/top.m3u8"\n#EXT-X-MEDIA:TYPE=SUBTITLES,LANGUAGE="en",NAME="E"\n#EXT-X-MEDIA:TYPE=SUBTITLES,LANGUAGE="de",NAME="D",URI="https://o/d"\n'
    tracks = manifests.hls_subtitles(one(spark, raw, base="https://h/v/1/"))
    assert [(r.lang, r.auto, r.url) for r in tracks.orderBy("place").collect()] == [("ru", True, "https://h/v/1/m.m3u8?id=1"), ("ru", False, "https://h/top.m3u8"), ("de", False, "https://o/d")]
    assert manifests.pick_subtitle(tracks).first().name == "Russian"
    assert manifests.pick_subtitle(tracks, ("fr",)).count() == 0


def test_pick_caption(spark):
    rows = [("s", 0, "en", "srt", "u0", False), ("s", 1, "ru-orig", "vtt", "u1", True), ("s", 2, "en", "vtt", "u2", False), ("s", 3, "en", "json3", "", False), ("t", 0, "ru", "x", "u4", True), ("t", 1, "ru", "y", "u5", True), ("u", 0, "de", "vtt", "u6", False)]
    df = spark.createDataFrame(rows, "series string, place bigint, lang string, ext string, url string, auto boolean")
    assert {(r.series, r.url) for r in manifests.pick_caption(df).collect()} == {("s", "u2"), ("t", "u4")}


def test_media(spark):
    raw = json.dumps({"streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "av1", "width": 1920, "height": 1080, "r_frame_rate": "30/1", "avg_frame_rate": "2400/100"}], "format": {"duration": "12.5"}})
    df = spark.createDataFrame([("s", "p", raw), ("t", "q", "{}")], "series string, path string, raw string")
    (r,) = media.media_info(df, strict=False).collect()
    assert (r.duration, r.width, r.fps, r.vfr, r.codec) == (12.5, 1920, 24.0, True, "av1")
    with pytest.raises(Exception, match="no video stream"):
        media.media_info(df).collect()
    files = spark.createDataFrame([("s", bytearray(b"ab")), ("t", bytearray(b"xyz"))], "series string, content binary")
    decode = lambda s, content, how: ((i, i / how["fps"], i % 2 == 0, [float(b)]) for i, b in enumerate(content))
    frames = media.decoded(files, decode)
    assert frames.count() == 5 and media.keyframe_times(frames).count() == 3
    images = spark.createDataFrame([(f"p{k}",) for k in range(7)], "path string")
    seen = {r.path: r.text for r in media.recognised(images, lambda paths: {p: " " if p == "p1" else f"{p}!" for p in paths if p != "p2"}, 3).collect()}
    assert seen["p0"] == "p0!" and seen["p1"] is None and seen["p2"] is None and len(seen) == 7
    heard = media.transcribed(files, [lambda c: [], lambda c: [(0.0, 1.0, f"{len(c)}")]]).collect()
    assert sorted((h.series, h.text) for h in heard) == [("s", "2"), ("t", "3")]
