"""Frames of media files as a Spark data source, cut by time ranges.

Each partition is a range of one file's time, so a long file is decoded by many tasks,
and a filter on time or series leaves out the partitions that can't hold a row of it. What a filter says
about time and key frames goes to the decoder, which can seek and skip.

    register(spark)
    frames(spark, media, "mydecoders:decode").filter("t >= 60 and t < 90 and keyframe")

A decoder is named by module and function, which workers import. It gets path, start, end
(seconds, the end left out) and how (``keyframes``, ``fps``), and yields rows of
number, time, whether it is a key frame, and pixels.
"""

from __future__ import annotations

import importlib
import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "series string, i bigint, t double, keyframe boolean, pixels array<double>"
#: seconds of a partition, frames a second of a dense scan, frames that a worker holds
RANGE_SECONDS, FPS, HELD = 600.0, 4.0, 64
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class TimeRange(InputPartition):
    """Part of a file; bounds of the time that is asked for within it."""

    series: str
    path: str
    start: float
    end: float


def _decoder(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class FrameReader(DataSourceReader):
    """``low`` and ``high`` are bounds of time, the lower one belonging to it and the upper one not."""

    def __init__(self, options: dict[str, str]) -> None:
        self.media = json.loads(options["media"])
        self.decoder = options["decoder"]
        self.seconds = float(options.get("rangeseconds", RANGE_SECONDS))
        self.how = {"keyframes": options.get("keyframes", "false").lower() == "true", "fps": float(options.get("fps", FPS))}
        self.low, self.high = 0.0, math.inf
        self.series: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on time, series and key frames, and keeps to them exactly; others stay with Spark."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            after = lambda x: math.nextafter(float(x), math.inf)
            if column == ("t",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, after(value) if isinstance(f, GreaterThan) else float(value))
            elif column == ("t",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, float(value) if isinstance(f, LessThan) else after(value))
            elif column == ("t",) and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, float(value)), min(self.high, after(value))
            elif column == ("series",) and isinstance(f, (EqualTo, In)):
                named = {value} if isinstance(f, EqualTo) else set(value)
                self.series = named if self.series is None else self.series & named
            elif column == ("keyframe",) and isinstance(f, EqualTo) and value is True:
                self.how["keyframes"] = True
            else:
                yield f

    def partitions(self) -> list[TimeRange]:
        out = []
        for series, path, duration in self.media:
            if self.series is not None and series not in self.series:
                continue
            for k in range(int(max(self.low, 0) // self.seconds), math.ceil(min(self.high, duration) / self.seconds)):
                start, end = max(self.low, k * self.seconds), min(self.high, duration, (k + 1) * self.seconds)
                if start < end:
                    out.append(TimeRange(series, path, start, end))
        return out

    def read(self, partition: TimeRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing is asked for
            return
        found = _decoder(self.decoder)(partition.path, partition.start, partition.end, self.how)
        rows = ((partition.series, *r) for r in found if partition.start <= r[1] < partition.end and (r[2] or not self.how["keyframes"]))
        types = [pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.list_(pa.float64())]
        while held := list(islice(rows, HELD)):
            columns = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=["series", "i", "t", "keyframe", "pixels"])


class FrameSource(DataSource):
    """Options: ``media`` (JSON rows of series, path, seconds), ``decoder``, and ``rangeSeconds``, ``fps``, ``keyframes``."""

    @classmethod
    def name(cls) -> str:
        return "media_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the source known. It needs a session that has ``PUSHDOWN`` on, as Spark reads no source that takes filters without it."""
    spark.dataSource.register(FrameSource)


def frames(spark: SparkSession, media: DataFrame, decoder: str, **options: str) -> DataFrame:
    """Frames of ``media`` (series, path, duration in seconds), one row a file: the list of files is all that the driver gets, as with any file source."""
    listed = [[r["series"], r["path"], r["duration"]] for r in media.select("series", "path", "duration").collect()]
    return spark.read.format("media_frames").options(media=json.dumps(listed), decoder=decoder, **options).load()
