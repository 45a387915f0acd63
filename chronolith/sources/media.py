"""Media as Spark sources: probe results, dense frames from a decoder, text from a recogniser.

Decoding, recognising and transcribing are outside programs. Each is a function that a
worker calls on a batch of rows; which one is a parameter, so none is needed here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio, variable_rate

_PROBE = (
    "struct<streams: array<struct<codec_type: string, codec_name: string, width: int, height: int, r_frame_rate: string, "
    "avg_frame_rate: string, duration: string>>, format: struct<duration: string>>"
)
FRAMES = "series string, i bigint, t double, keyframe boolean, pixels array<double>"
#: images that a recogniser gets at once
IMAGES_PER_CALL = 60

Decoder = Callable[[str, bytes, dict], Iterator[tuple[int, float, bool, list[float]]]]
Recogniser = Callable[[list[str]], dict[str, str]]
Transcriber = Callable[[bytes], list[tuple[float, float, str]]]


def media_info(probes: DataFrame, strict: bool = True) -> DataFrame:
    """``series, path, duration, width, height, fps, vfr, codec`` from rows ``series, path, raw`` of probe output.

    Without a video stream or a positive duration a row raises an error if ``strict``, else it goes.
    """
    p = probes.withColumn("p", F.from_json("raw", _PROBE)).withColumn("v", F.get(F.filter("p.streams", lambda s: s["codec_type"] == "video"), 0))
    seconds = F.coalesce(F.col("p.format.duration").try_cast("double"), F.col("v.duration").try_cast("double"), F.lit(0.0))
    rate, average = ratio(F.col("v.r_frame_rate")), ratio(F.col("v.avg_frame_rate"))
    good = F.col("v").isNotNull() & (seconds > 0)
    if strict:
        p = p.withColumn("path", F.when(good, F.col("path")).otherwise(F.raise_error(F.lit("no video stream or no duration")).cast("string")))
    else:
        p = p.filter(good)
    fps = F.when(average > 0, average).otherwise(rate)
    return p.select("series", "path", seconds.alias("duration"), F.col("v.width").alias("width"), F.col("v.height").alias("height"), fps.alias("fps"), variable_rate(rate, average).alias("vfr"), F.col("v.codec_name").alias("codec"))


def decoded(files: DataFrame, decoder: Decoder, keyframes: bool = False, fps: float = 4.0) -> DataFrame:
    """Dense frames of rows ``series, content``. The decoder yields frames one by one, and 256 at most are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                held = []
                for i, t, key, pixels in decoder(row.series, row.content, {"keyframes": keyframes, "fps": fps}):
                    held.append((row.series, i, t, key, pixels))
                    if len(held) == 256:
                        yield pd.DataFrame(held, columns=["series", "i", "t", "keyframe", "pixels"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["series", "i", "t", "keyframe", "pixels"])

    return files.select("series", "content").mapInPandas(run, FRAMES)


def keyframe_times(frames: DataFrame) -> DataFrame:
    """``series, t``: times of key frames, each once."""
    return frames.filter("keyframe").select("series", "t").distinct()


def recognised(images: DataFrame, recognise: Recogniser, batch: int = IMAGES_PER_CALL) -> DataFrame:
    """``path, text`` of images by path; at most ``batch`` paths a call. Blank texts and paths without an answer are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for lo in range(0, len(rows), batch):
                paths = rows["path"].iloc[lo : lo + batch].tolist()
                found = recognise(paths)
                yield pd.DataFrame({"path": paths, "text": [(found.get(p) or "").strip() or None for p in paths]})

    return images.select("path").mapInPandas(run, "path string, text string")


def transcribed(audio: DataFrame, cascade: list[Transcriber]) -> DataFrame:
    """``series, i, t0, t1, text`` of rows ``series, content`` by the first transcriber that hears anything."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples():
                heard = next((h for listen in cascade if (h := listen(row.content))), [])
                yield pd.DataFrame([(row.series, i, a, b, text) for i, (a, b, text) in enumerate(heard)], columns=["series", "i", "t0", "t1", "text"])

    return audio.select("series", "content").mapInPandas(run, "series string, i bigint, t0 double, t1 double, text string")
