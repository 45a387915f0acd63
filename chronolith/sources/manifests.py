"""Streaming manifests as rows: DASH tracks, HLS subtitle tracks, and the choice among tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import iso_duration

_MPD = (
    "_mediaPresentationDuration string, Period array<struct<AdaptationSet: array<struct<_mimeType: string, "
    "ContentProtection: array<string>, Representation: array<struct<_codecs: string, _height: int, _bandwidth: bigint, "
    "BaseURL: string, ContentProtection: array<string>, SegmentList: array<struct<SegmentURL: array<struct<_media: string, _mediaRange: string>>>>>>>>>>"
)


def dash_tracks(manifests: DataFrame, strict: bool = True) -> DataFrame:
    """``series, kind, url, size, height, codec, bandwidth, duration`` from rows ``series, raw``.

    A segment's media path is ``from/to/name``: the largest end is the track's size, and
    ``0/size/name`` is all of it. Without media paths the base is the file, and the
    largest last byte plus one its size. Encrypted manifests raise an error if
    ``strict``, else they give no track.
    """
    plain = F.regexp_replace("raw", r'\sxmlns(:\w+)?="[^"]*"', "")
    encrypted = F.col("raw").rlike(r"<(\w+:)?ContentProtection[\s/>]")
    refuse = F.raise_error(F.lit("manifest is encrypted")).cast("string") if strict else F.lit(None).cast("string")
    mpd = manifests.withColumn("mpd", F.from_xml(F.when(encrypted, refuse).otherwise(plain), _MPD))
    sets = mpd.select("series", iso_duration(F.coalesce("mpd._mediaPresentationDuration", F.lit(""))).alias("duration"), F.explode("mpd.Period").alias("p")).select("series", "duration", F.explode("p.AdaptationSet").alias("a"))
    reps = sets.select("series", "duration", F.when(F.coalesce("a._mimeType", F.lit("")).contains("audio"), "audio").otherwise("video").alias("kind"), F.explode("a.Representation").alias("r"))
    segments = F.flatten(F.transform("r.SegmentList", lambda s: s["SegmentURL"]))
    media = F.filter(F.transform(segments, lambda s: s["_media"]), lambda m: m.isNotNull() & (m != ""))
    ends = F.filter(F.transform(segments, lambda s: F.split_part(s["_mediaRange"], F.lit("-"), F.lit(2)).try_cast("bigint")), lambda e: e.isNotNull())

    def path(m: Column) -> Column:
        steps = F.split(F.split_part(m, F.lit("?"), F.lit(1)), "/")
        size = F.when(F.size(steps) >= 3, F.get(steps, 1).try_cast("bigint"))
        query = F.split_part(m, F.lit("?"), F.lit(2))
        return F.struct(size.alias("size"), F.element_at(steps, -1).alias("name"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("").alias("query"))

    largest = F.aggregate(F.transform("media", path), F.lit(None).cast("struct<size: bigint, name: string, query: string>"), lambda acc, p: F.when(F.coalesce(p["size"], F.lit(0)) > F.coalesce(acc["size"], F.lit(0)), p).otherwise(acc))
    rows = reps.withColumn("base", F.trim("r.BaseURL")).withColumn("media", media).withColumn("best", largest).withColumn("end", F.array_max(ends) + 1)
    by_path = F.size("media") > 0
    rows = rows.withColumn("size", F.when(by_path, F.col("best.size")).otherwise(F.col("end"))).filter("base <> '' and size is not null")
    url = F.when(by_path, F.concat("base", F.lit("0/"), F.col("size").cast("string"), F.lit("/"), F.col("best.name"), F.col("best.query"))).otherwise(F.col("base"))
    return rows.select("series", "kind", url.alias("url"), "size", F.coalesce("r._height", F.lit(0)).alias("height"), F.coalesce("r._codecs", F.lit("")).alias("codec"), F.coalesce("r._bandwidth", F.lit(0)).alias("bandwidth"), "duration")


def attributes(line: Column) -> Column:
    """``KEY="value"`` and ``KEY=value`` of a tag line as a map; of a repeated key the last."""
    # fixed value: attributes of tag lines as the playlist format writes them
    pattern = F.lit(r'([A-Za-z0-9-]+)=(?:"([^"]*)"|([^,]*))')
    of = lambda group: F.regexp_extract_all(line, pattern, F.lit(group))
    values = F.zip_with(of(2), of(3), lambda q, b: F.when(q != "", q).otherwise(b))
    keys = of(1)
    last = F.filter(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v"))), lambda p: p.isNotNull())
    numbered = F.transform(last, lambda p, i: F.struct(p["k"], p["v"], (F.array_position(F.slice(keys, i + 2, F.size(keys)), p["k"]) == 0).alias("final")))
    return F.map_from_entries(F.transform(F.filter(numbered, lambda p: p["final"]), lambda p: F.struct(p["k"], p["v"])))


def hls_subtitles(playlists: DataFrame) -> DataFrame:
    """``series, place, lang, name, url, auto`` of subtitle lines in rows ``series, raw, base`` (``base``: what relative links stand behind)."""
    lines = playlists.select("series", "base", F.posexplode(F.split("raw", r"\r\n|[\n\r]")).alias("place", "line")).filter(F.col("line").startswith("#EXT-X-MEDIA:"))
    a = lines.withColumn("a", attributes(F.substr("line", F.lit(14))))
    uri = F.col("a")["URI"]
    found = a.filter((F.upper(F.coalesce(F.col("a")["TYPE"], F.lit(""))) == "SUBTITLES") & uri.isNotNull() & (uri != ""))
    name = F.coalesce(F.col("a")["NAME"], F.lit(""))
    host = F.regexp_extract("base", r"^(\w+://[^/]+)", 1)
    url = F.when(uri.rlike(r"^\w+://"), uri).when(uri.startswith("/"), F.concat(host, uri)).otherwise(F.concat("base", uri))
    # fixed value: the words by which automatic tracks are known
    return found.select("series", "place", F.lower(F.coalesce(F.col("a")["LANGUAGE"], F.lit(""))).alias("lang"), name.alias("name"), url.alias("url"), F.lower(name).rlike("авто|auto").alias("auto"))


def pick_video(tracks: DataFrame, max_height: int = 1080) -> DataFrame:
    """The highest track within a height, or the highest of all; of equal ones that of most bandwidth."""
    fits = F.col("height") <= max_height
    return _best(tracks.filter("kind = 'video'"), F.max_by, F.struct(fits, "height", "bandwidth"))


def pick_audio(tracks: DataFrame) -> DataFrame:
    return _best(tracks.filter("kind = 'audio'"), F.max_by, F.struct("bandwidth"))


def pick_subtitle(tracks: DataFrame, langs: tuple[str, ...] = ("ru", "en")) -> DataFrame:
    """The first wanted language's track, one made by hand before an automatic one, the earlier of equals."""
    rank = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang"))
    return _best(tracks.filter(rank > 0), F.min_by, F.struct(rank, F.col("auto"), F.col("place")))


def pick_caption(tracks: DataFrame, langs: tuple[str, ...] = ("ru", "en"), kinds: tuple[str, ...] = ("json3", "vtt", "srv3", "ttml")) -> DataFrame:
    """Of rows ``series, place, lang, ext, url, auto`` the one to load: by hand first, then language (or its original), then kind, else the first listed."""
    names = [y for x in langs for y in (x, f"{x}-orig")]
    rank = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("lang"))
    kind = F.array_position(F.array(*[F.lit(x) for x in kinds]), F.col("ext"))
    usable = tracks.filter((rank > 0) & F.col("url").isNotNull() & (F.col("url") != ""))
    return _best(usable, F.min_by, F.struct(F.col("auto"), rank, F.when(kind > 0, kind).otherwise(len(kinds) + 1), F.col("place")))


def _best(tracks: DataFrame, by, rank: Column) -> DataFrame:
    return tracks.groupBy("series").agg(by(F.struct(*[c for c in tracks.columns if c != "series"]), rank).alias("t")).select("series", "t.*")
