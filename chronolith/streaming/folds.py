"""Folds over streams that end with the rows of the batch operators.

Rows of a series come in any order within the watermark's delay. They wait in a list of
the state; when the watermark has passed them, a timer hands them on in order of time,
and a fold with one row of state decides. What it holds back goes out when nothing can
change it any more. State lives in the RocksDB store, so a stream goes on where its
checkpoint ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: what a session needs for these operators
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

Row = tuple[Any, ...]


class OrderedFold(StatefulProcessor):
    """Hands rows to ``step`` in order of their first column (milliseconds), once the watermark has passed them.

    ``step(held, row)`` gives what goes out and what is held from then on; ``due(held)`` is
    the time from which no row can change what is held, and it goes out then.
    """

    row: str
    held: str
    out: str

    def step(self, held: Row | None, row: Row) -> tuple[list[Row], Row]:
        raise NotImplementedError

    def due(self, held: Row) -> int:
        raise NotImplementedError

    def shown(self, held: Row) -> Row:
        return held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.last = handle.getValueState("last", self.held)

    def _alarm(self, times: list[int], now: int) -> None:
        """One timer, at the first of ``times``; those that have passed ring as soon as they can."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if times:
            self.handle.registerTimer(max(min(times), now + 1))

    def handleInputRows(self, key: Row, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in self.row.split(", ")]
        new = [r for batch in rows for r in batch[names].itertuples(index=False, name=None)]
        self.waiting.appendList([_plain(r) for r in new])
        times = [int(r[0]) for r in new] + [int(t) for t in self.handle.listTimers()]
        self._alarm(times, timerValues.getCurrentWatermarkInMs())
        yield from ()

    def handleExpiredTimer(self, key: Row, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=self.order)
        ready = [r for r in rows if r[0] <= now]
        left = rows[len(ready) :]
        held = tuple(self.last.get()) if self.last.exists() else None
        out: list[Row] = []
        for r in ready:
            if held is not None and self.due(held) <= r[0]:
                out.append(self.shown(held))
                held = None
            gone, held = self.step(held, r)
            out += gone
        if held is not None and self.due(held) <= now:
            out.append(self.shown(held))
            held = None
        if left:
            self.waiting.put([_plain(r) for r in left])
        else:
            self.waiting.clear()
        if held is None:
            self.last.clear()
        else:
            self.last.update(_plain(held))
        self._alarm([r[0] for r in left] + ([self.due(held)] if held is not None else []), now)
        if out:
            names = [c.split()[0] for c in self.out.split(", ")]
            yield pd.DataFrame([(*key, *r) for r in out], columns=names)

    def order(self, row: Row) -> Any:
        return row[:1]

    def close(self) -> None:
        pass


def _plain(row: Row) -> Row:
    """Values as Python's own types, as state rows need them."""
    return tuple(v.tolist() if isinstance(v, (np.generic, np.ndarray)) else list(v) if isinstance(v, (list, tuple)) else v for v in row)


class ThinClose(OrderedFold):
    row = "t_ms bigint, change double"
    held = row
    out = "series string, t_ms bigint, change double"

    def __init__(self, min_gap: int) -> None:
        self.min_gap = min_gap

    def step(self, held: Row | None, row: Row) -> tuple[list[Row], Row]:
        if held is None:
            return [], row
        return [], row if row[1] > held[1] else held  # a row that is far enough finds nothing held

    def due(self, held: Row) -> int:
        return held[0] + self.min_gap


class SameScreens(OrderedFold):
    row = "t_ms bigint, reason string, change double, pixels array<double>, seen array<boolean>"
    held = row + ", replaced bigint"
    out = "series string, t_ms bigint, reason string, change double, replaced bigint"

    def __init__(self, delta: float, same: float, idle: int) -> None:
        self.delta, self.same, self.idle = delta, same, idle

    def order(self, row: Row) -> Any:
        return row[:3]

    def step(self, held: Row | None, row: Row) -> tuple[list[Row], Row]:
        if held is None:
            return [], (*row, 0)
        seen = held[4]  # the first row's, for all of a series
        mask = np.array(seen) if any(seen) else np.ones(len(seen), bool)
        far = np.abs(np.array(row[3], float) - np.array(held[3], float)) > self.delta
        if "grid" in (row[1], held[1]) or far[mask].mean() > self.same:
            return [self.shown(held)], (*row[:4], seen, 0)
        return [], (*row[:4], seen, held[5] + 1)

    def due(self, held: Row) -> int:
        return held[0] + self.idle

    def shown(self, held: Row) -> Row:
        return (*held[:3], held[5])


def _run(rows: DataFrame, late: str, fold: OrderedFold) -> DataFrame:
    names = [c.split()[0] for c in fold.row.split(", ")]
    timed = rows.withWatermark("ts", late).withColumn("t_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return timed.select("series", "ts", *names).groupBy("series").transformWithStateInPandas(fold, fold.out, "Append", "EventTime")


def thin_close(moments: DataFrame, min_gap_ms: int, late: str) -> DataFrame:
    """``series, t_ms, change`` as ``greedy.thin_close`` keeps them, of a stream ``series, ts, change``.

    Rows that come more than ``late`` behind are dropped. A kept row goes out once the
    watermark is ``min_gap_ms`` past it.
    """
    return _run(moments, late, ThinClose(min_gap_ms))


def drop_same_screens(moments: DataFrame, delta: float, same: float, late: str, idle_ms: int) -> DataFrame:
    """``series, t_ms, reason, change, replaced`` as ``greedy.drop_same_screens`` keeps them, of a stream ``series, ts, reason, change, pixels, seen``.

    A screen goes out when another one comes, or ``idle_ms`` after its last row: then the series
    begins anew, which is all that differs from the batch operator. A state holds one screen and the rows
    within the delay.
    """
    return _run(moments, late, SameScreens(delta, same, idle_ms))
