"""Outside recognisers as SQL table functions over tables of any size.

    register(spark)
    SELECT * FROM recognise(TABLE(images) PARTITION BY (shard), 'mymodule:read_texts', 60)
    SELECT * FROM transcribe(TABLE(audio), 'fast:listen,slow:listen')

Each is named by module and function, which workers import. A partition's rows meet the
outside program some at a time; how rows are dealt out is the query's PARTITION BY.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .media import IMAGES_PER_CALL


def _named(name: str) -> Callable:
    module, _, function = name.strip().partition(":")
    return getattr(importlib.import_module(module), function)


def _of_table(table: AnalyzeArgument, *columns: str) -> StructType:
    """The table's type, if it is one and has the columns."""
    if not table.isTable:
        raise ValueError("the first argument must be TABLE(...)")
    lacking = [c for c in columns if c not in table.dataType.fieldNames()]
    if lacking:
        raise ValueError(f"the table has no column {lacking[0]}")
    return table.dataType


class Recognise:
    """Rows of a table with a column ``path``, and ``text`` of the image there.

    The recogniser gets a list of at most ``batch`` paths and gives a dict. A path that it
    leaves out, a blank text, and every path of a call that fails have null.
    """

    def __init__(self) -> None:
        self.waiting: list[Row] = []
        self.how: tuple[str, int] | None = None

    @staticmethod
    def analyze(table: AnalyzeArgument, recogniser: AnalyzeArgument, batch: AnalyzeArgument | None = None) -> AnalyzeResult:
        kept = [f for f in _of_table(table, "path") if f.name != "text"]
        return AnalyzeResult(StructType([*kept, StructField("text", StringType())]))

    def eval(self, table: Row, recogniser: str, batch: int = IMAGES_PER_CALL) -> Iterator[tuple]:
        self.how = (recogniser, batch)
        self.waiting.append(table)
        if len(self.waiting) >= batch:
            yield from self._told()

    def terminate(self) -> Iterator[tuple]:
        yield from self._told()

    def _told(self) -> Iterator[tuple]:
        rows, self.waiting = self.waiting, []
        if not rows:
            return
        try:
            found = _named(self.how[0])([r["path"] for r in rows])
        except Exception:  # as one that answers nothing: the next call may do better
            found = {}
        for r in rows:
            kept: list[Any] = [r[c] for c in r.__fields__ if c != "text"]
            yield (*kept, (found.get(r["path"]) or "").strip() or None)


class Transcribe:
    """Speech of each row's ``content``: the table's other columns, ``i``, ``t0``, ``t1``, ``text`` and ``source``, which of the engines heard it.

    Engines are tried in their order, row by row: one that fails or hears nothing leaves
    the row to the next. A row that none of them hears gives nothing.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, engines: AnalyzeArgument) -> AnalyzeResult:
        kept = [f for f in _of_table(table, "content") if f.name != "content"]
        heard = [StructField("i", IntegerType()), StructField("t0", DoubleType()), StructField("t1", DoubleType()), StructField("text", StringType()), StructField("source", StringType())]
        return AnalyzeResult(StructType([*kept, *heard]))

    def eval(self, table: Row, engines: str) -> Iterator[tuple]:
        for name in engines.split(","):
            try:
                heard = list(_named(name)(table["content"]))
            except Exception:
                continue
            if heard:
                kept = [table[c] for c in table.__fields__ if c != "content"]
                for i, (t0, t1, text) in enumerate(heard):
                    yield (*kept, i, float(t0), float(t1), str(text).strip(), name.strip())
                return


def register(spark: SparkSession) -> None:
    """``recognise`` and ``transcribe`` for SQL of this session."""
    spark.udtf.register("recognise", udtf(Recognise))
    spark.udtf.register("transcribe", udtf(Transcribe))
