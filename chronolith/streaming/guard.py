"""Live coverage: the same rules on a stream of moments, in event time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GUARDED = "series string, t_ms bigint, reason string"


def sessions(signal: DataFrame, threshold: float, gap: str, late: str) -> DataFrame:
    """Bursts of a stream ``series, ts, change``: closed once no active sample came for ``gap``; rows over ``late`` old are dropped."""
    active = signal.withWatermark("ts", late).filter(F.col("change") >= threshold)
    by_burst = active.groupBy("series", F.session_window("ts", gap).alias("w")).agg(F.max("change").alias("strength"), F.count(F.lit(1)).alias("n"))
    return by_burst.select("series", F.col("w.start").alias("ts_from"), F.col("w.end").alias("ts_to"), "strength", "n")


def guard(moments: DataFrame, max_gap_ms: int, late: str) -> DataFrame:
    """Moments of a stream ``series, ts``, with grid points put into stretches over ``max_gap_ms``.

    The state of a series is its last moment. A stretch is filled evenly when its far end
    comes; if none comes, the watermark's passing of ``last + max_gap`` puts one point there. Rows older
    than the last moment are let through and fill nothing.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple[str, int, str]] = []
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            last += max_gap_ms
            out.append((key[0], last, "grid"))
        else:
            times = sorted(int(t) for batch in batches for t in batch["t_ms"])
            for t in times:
                if last is not None and t - last > max_gap_ms:
                    n = (t - last) // max_gap_ms
                    out += [(key[0], last + (t - last) * k // (n + 1), "grid") for k in range(1, n + 1)]
                out.append((key[0], t, "moment"))
                last = t if last is None else max(last, t)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + max_gap_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["series", "t_ms", "reason"])

    timed = moments.withWatermark("ts", late).withColumn("t_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return timed.groupBy("series").applyInPandasWithState(step, GUARDED, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
