"""Choices that hang on what was kept before, one series (or burst, or island) at a time.

Each is a left fold over rows in order of time that no window function can tell, run by
grouped pandas functions; what is independent (bursts, islands of near candidates) is
cut apart first, so that a long series still spreads.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import scans

#: fixed values: seconds over which a burst is split and between moments; novelty of one moment; share of equal screens
SPLIT_SECONDS, MIN_GAP_SECONDS, NOVELTY, SAME_SCREEN = 2.5, 0.75, 5.0, 0.001
CUE_SECONDS = 3.0
#: bursts of a series that one call gets
TOGETHER = 256
#: moments of a series too long for its budget that a block should have at least
BUDGET_ROWS = 2048
#: reasons by worth: a grid point goes first, a caught change last
WORTH = {"grid": 0, "cue": 1, "change": 2}


def split_bursts(samples: DataFrame, split: int, budget: float, min_gap: int) -> DataFrame:
    """``series, burst, i, t``: one moment at the end of a short burst, in a long one a moment whenever change adds up to ``budget``.

    ``samples`` has ``series, burst, i, t, change`` of each burst up to where it settles.
    Bursts are folded apart from each other; TOGETHER of them go to Python at once.
    """

    def of_one(t: np.ndarray, change: np.ndarray) -> list[int]:
        last = len(t) - 1
        picked: list[int] = []
        if t[last] - t[0] > split:
            held = 0.0
            for k in range(len(t)):
                held += change[k]
                if held >= budget and (not picked or t[k] - t[picked[-1]] >= min_gap):
                    picked.append(k)
                    held = 0.0
        if not picked or (picked[-1] != last and t[last] - t[picked[-1]] >= min_gap):
            picked.append(last)
        return picked

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["burst", "i"])
        t, change, burst = rows["t"].to_numpy(), rows["change"].to_numpy(), rows["burst"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], burst[1:] != burst[:-1]]))
        ends = np.concatenate([starts[1:], [len(rows)]])
        return rows.iloc[[a + k for a, b in zip(starts, ends, strict=True) for k in of_one(t[a:b], change[a:b])]][["series", "burst", "i", "t"]]

    kinds = samples.select("series", "burst", "i", "t").schema
    return samples.groupBy("series", F.expr(f"burst div {TOGETHER}")).applyInPandas(choose, kinds)


def _follow(t: np.ndarray, change: np.ndarray, min_gap: int) -> np.ndarray:
    """Of each row, once it is kept last, the next one that is kept: the first that is far enough or stronger; the number of rows if none is."""
    n = len(t)
    out = np.full(n, n)
    far = np.searchsorted(t, t + min_gap)
    rising: list[int] = []  # rows behind, the nearest last, each stronger than those nearer
    for k in range(n - 1, -1, -1):
        while rising and change[rising[-1]] <= change[k]:
            rising.pop()
        out[k] = min(far[k], rising[-1] if rising else n)
        rising.append(k)
    return out


def _entered(t: np.ndarray, change: np.ndarray, last: tuple[int, float] | None, min_gap: int) -> int:
    """The first row that is kept after ``last``, which lies before all of them."""
    if last is None:
        return 0
    stronger = np.flatnonzero(change > last[1])
    return int(min(np.searchsorted(t, last[0] + min_gap), stronger[0] if len(stronger) else len(t)))


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows in frames of whole groups, with the bounds of these; a group that goes over several batches is put together."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        first, final = held[0][keys].iloc[0], batch[keys].iloc[-1]
        if all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(first, final, strict=True)):
            continue  # still in the group that the first of these rows is in
        rows = pd.concat(held, ignore_index=True)
        bounds = _bounds(rows, keys)
        yield rows.iloc[: bounds[-2]], bounds[:-1]
        held = [rows.iloc[bounds[-2] :]]
    if held:
        rows = pd.concat(held, ignore_index=True)
        yield rows, _bounds(rows, keys)


def _bounds(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(rows) - 1, bool)
    for k in keys:
        x = rows[k].to_numpy()
        none = pd.isna(x)
        new |= (x[1:] != x[:-1]) & ~(none[1:] & none[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(rows)]])


BLOCK_EXITS = "block_ bigint, t array<bigint>, change array<double>, last_t array<bigint>, last_change array<double>"


def thin_close(moments: DataFrame, min_gap: int, span: int | None = None) -> DataFrame:
    """Of moments closer than ``min_gap`` to the last kept one the stronger stays (of equals the earlier).

    Rows ``series, t, change`` and what else they have; neither time nor change is null. What is kept next hangs on the
    last kept row alone, so a block of time (``span``, 256 gaps unless given) is a map: for each row near its start, if it is kept
    first, which row is kept last. These small maps are composed along the series, and then every
    block knows the row that it is entered with: a series of rows that are all close is
    spread like any other. A task holds a block's rows.
    """
    span = max(span or 256 * min_gap, min_gap)
    names = moments.columns
    rows = moments.withColumn("block_", scans.block_of(F.col("t"), span))

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found, bounds in _groups(batches, ["series", "block_"]):
            ts, changes, told = found["t"].to_numpy(), found["change"].to_numpy(), []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                t, change = ts[lo:hi], changes[lo:hi]
                after = _follow(t, change, min_gap).tolist()
                end = list(range(hi - lo))
                for k in range(hi - lo - 1, -1, -1):
                    end[k] = end[after[k]] if after[k] < hi - lo else k
                near = min(hi - lo, int(np.searchsorted(t, t[0] + min_gap)) + 1)  # whoever comes from before enters at one of these
                told.append((t[:near], change[:near], t[end[:near]], change[end[:near]]))
            heads = found.iloc[bounds[:-1]]
            yield pd.DataFrame({"series": heads["series"].to_numpy(), "block_": heads["block_"].to_numpy()} | {c: pd.Series([x[j] for x in told], dtype=object) for j, c in enumerate(("t", "change", "last_t", "last_change"))})

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of a series in order; what is kept last goes from one to the next, and is told to both if the next takes its place."""
        columns = ["series", "block_", "last_t_", "last_change_", "taken_"]
        series = last = pending = None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if series != r.series:
                    if pending is not None:
                        out.append((*pending, False))
                    series, last, pending = r.series, None, None
                first = _entered(r.t, r.change, last, min_gap)
                if first == len(r.t):  # nothing of the block is kept, and what was kept last still is
                    continue
                if pending is not None:
                    out.append((*pending, bool(r.t[first] < last[0] + min_gap)))
                pending = (series, r.block_, *(last or (None, None)))
                last = (int(r.last_t[first]), float(r.last_change[first]))
            yield pd.DataFrame(out, columns=columns)
        if pending is not None:
            yield pd.DataFrame([(*pending, False)], columns=columns)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found, bounds in _groups(batches, ["series", "block_"]):
            ts, changes, kept = found["t"].to_numpy(), found["change"].to_numpy(), []
            heads = found.iloc[bounds[:-1]]
            for lo, hi, last_t, last_change, taken in zip(bounds, bounds[1:], heads["last_t_"], heads["last_change_"], heads["taken_"], strict=False):
                t, change = ts[lo:hi], changes[lo:hi]
                last = None if pd.isna(last_t) else (int(last_t), float(last_change))
                after, k = _follow(t, change, min_gap).tolist(), _entered(t, change, last, min_gap)
                while k < hi - lo:
                    far = after[k] == hi - lo or t[after[k]] - t[k] >= min_gap
                    if far and not (taken and after[k] == hi - lo):
                        kept.append(lo + k)
                    k = after[k]
            yield found.iloc[kept][names]

    kind = moments.schema["series"].dataType.simpleString()
    order = ["t", F.desc("change")]
    in_blocks = rows.select("series", "block_", "t", "change").repartition("series", "block_").sortWithinPartitions("series", "block_", *order)
    maps = cut(in_blocks.mapInPandas(exits, f"series {kind}, {BLOCK_EXITS}"))
    entered = maps.repartition("series").sortWithinPartitions("series", "block_").mapInPandas(compose, f"series {kind}, block_ bigint, last_t_ bigint, last_change_ double, taken_ boolean")
    return scans.given(rows, entered, ["series", "block_"], order).mapInPandas(keep, moments.schema)


def drop_same_screens(moments: DataFrame, delta: float, same: float = SAME_SCREEN, span: int = 1 << 22) -> DataFrame:
    """A moment whose screen equals that of the last kept one takes its place; grid points neither take nor give place.

    Rows ``series, t, reason, change, pixels, seen`` (``seen``: a flag for each pixel
    that counts; a series' first row has those of all); what is kept comes with ``replaced``, how many it took the place of.
    A series is cut into blocks of ``span`` of time.
    """

    order, block = ["t", "reason", "change"], scans.block_of(F.col("t"), span)
    first = moments.groupBy("series").agg(F.min_by("seen", F.struct(*order)).alias("mask_"))
    # what is kept last is always the row before: that one either was appended or took the last one's place
    rows = scans.lagged(moments, block, order, ["pixels", "reason"]).join(first, "series").withColumn("grid_", (F.col("reason") == "grid") | (F.col("before_.reason") == "grid"))
    rows = rows.withColumn("mask_", F.when(F.exists("mask_", lambda m: m), F.col("mask_")).otherwise(F.transform("mask_", lambda m: F.lit(True))))

    def differs(x, y):
        far = F.abs(x.cast("double") - y.cast("double"))
        return F.coalesce((far > delta) & ~F.isnan(far), F.lit(False))

    far = F.zip_with(F.zip_with("pixels", "before_.pixels", differs), "mask_", lambda d, m: d & m)
    share = F.size(F.filter(far, lambda x: x)) / F.size(F.filter("mask_", lambda m: m))
    new = F.col("before_").isNull() | F.col("grid_") | (share > same)
    rows = rows.select("series", "t", "reason", "change", F.when(new, 1).otherwise(0).alias("new_"))
    rows = scans.running(rows, block, order, F.col("new_"), "screen_")
    of_screen = rows.groupBy("series", "screen_").agg(F.max(F.struct("t", "reason", "change")).alias("last"), (F.count(F.lit(1)) - 1).alias("replaced"))
    return of_screen.select("series", "last.t", "last.reason", "last.change", "replaced")


def cue_anchors(cues: DataFrame, moments: DataFrame, tolerance: int) -> DataFrame:
    """``series, t`` of cues farther than ``tolerance`` from every moment, and from cues that were taken before.

    Moments only matter within their tolerance: each cue looks at the nearest one on
    both sides in one pass over the series, and the fold runs over what is left.
    """
    both = moments.select("series", "t", F.lit(False).alias("cue")).unionByName(cues.select("series", "t", F.lit(True).alias("cue")))
    known = F.when(~F.col("cue"), F.col("t"))
    back = F.last(known, True).over(Window.partitionBy("series").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.last(known, True).over(Window.partitionBy("series").orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    near = F.least(F.coalesce(F.col("t") - back, F.lit(1 << 62)), F.coalesce(ahead - F.col("t"), F.lit(1 << 62)))
    free = both.withColumn("near", near).filter(F.col("cue") & (F.col("near") > tolerance)).select("series", "t")
    return thin_close(free.withColumn("change", F.lit(0.0)), tolerance + 1).select("series", "t")


def _drop_in_block(t: np.ndarray, worth: np.ndarray, strength: np.ndarray, place: np.ndarray, max_gap: int, before: tuple | None, after: tuple | None, start: int, end: int) -> tuple[list[int], list[tuple]]:
    """One round over a block's moments in order: which are dropped, and at what cost.

    ``before`` and ``after`` are the neighbours outside, with what dropping them would cost at least (none
    at the series' ends, where ``start`` and ``end`` stand). A moment goes while no neighbour would go before
    it; one that has to wait for a neighbour lets its own neighbours wait.
    """
    n = len(t)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    low, high = (before[0] if before else start), (after[0] if after else end)
    times = t.tolist()

    def cost(k: int) -> tuple:
        stretch = (times[right[k]] if right[k] < n else high) - (times[left[k]] if left[k] >= 0 else low)
        return (int(worth[k]), float(strength[k]), stretch, int(place[k]))

    waits = [False] * n
    heap = [(cost(k), k) for k in range(n) if place[k] > 0 or times[k] > 0]
    heapq.heapify(heap)
    dropped, costs = [], []
    while heap:
        known, k = heapq.heappop(heap)
        now = cost(k)
        if now[2] > max_gap:
            continue
        if now != known:
            heapq.heappush(heap, (now, k))
            continue
        i, j = left[k], right[k]
        outside = [x[1] for x in ((before if i < 0 else None), (after if j >= n else None)) if x is not None and x[1] is not None]
        if any(waits[x] for x in (i, j) if 0 <= x < n) or any(x < now for x in outside):
            waits[k] = True
            continue
        dropped.append(k)
        costs.append(now)
        if i >= 0:
            right[i] = j
        if j < n:
            left[j] = i
    return dropped, costs


def fit_budget(moments: DataFrame, blocks: int = 4096) -> DataFrame:
    """Drops moments until a series has ``cap`` of them, as far as no stretch becomes longer than its ``max_gap``.

    Rows ``series, t, reason, change, cap, duration, max_gap``, one a time. Of those that may go, the one of
    least worth goes first (a change by its strength), then the one that leaves the
    shortest stretch, then the earliest; a moment at 0 stays.

    Neighbours only draw apart, so costs only rise: what is cheaper than both its neighbours
    goes before them whatever happens elsewhere, and costs in order of dropping go up. So
    blocks of a timeline drop theirs by themselves, in rounds in which they tell each other their outermost moments, until none
    can; of all that could go, the cheapest are dropped, as many as are too many. A series
    that fits in one block needs one round. A task holds a block.
    """
    worth = F.element_at(F.create_map(*[F.lit(x) for pair in WORTH.items() for x in pair]), F.col("reason"))
    counted = moments.groupBy("series").agg(F.count("*").alias("n_"), F.max("cap").alias("cap_"))
    over = counted.filter(F.col("n_") > F.col("cap_")).select("series", (F.col("n_") - F.col("cap_")).alias("over_"), F.greatest(F.lit(1), F.least(F.lit(blocks), F.expr(f"n_ div {BUDGET_ROWS}"))).alias("parts_"))
    kind = moments.schema["series"].dataType.simpleString()
    block = F.floor(F.least(F.greatest(F.col("t"), F.lit(0)), F.col("duration")) / F.greatest(F.col("duration"), F.lit(1)) * (F.col("parts_") - F.lit(1e-9)))
    rows = moments.join(over, "series").select("series", "t", worth.alias("worth"), F.when(F.col("reason") == "change", F.col("change").cast("double")).otherwise(F.lit(0.0)).alias("strength"), "duration", "max_gap", block.alias("block"))
    state = cut(scans.running(rows, F.col("block"), ["t"], F.lit(1), "place").withColumn("place", F.col("place") - 1))
    edge = "struct<t: bigint, worth: int, strength: double, stretch: bigint, place: bigint>"
    told = f"series {kind}, t bigint, worth int, strength double, duration bigint, max_gap bigint, block bigint, place bigint, cost {edge}, fresh boolean"

    def round_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found, bounds in _groups(batches, ["series", "block"]):
            gone: dict[int, tuple] = {}
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                part = found.iloc[lo:hi]
                one = part.iloc[0]
                edges = [None if e is None else (e["t"], None if e["stretch"] > one.max_gap or e["place"] == 0 and e["t"] <= 0 else (e["worth"], e["strength"], e["stretch"], e["place"])) for e in (one.before, one.after)]
                dropped, costs = _drop_in_block(part["t"].to_numpy(), part["worth"].to_numpy(), part["strength"].to_numpy(), part["place"].to_numpy(), int(one.max_gap), *edges, 0, int(one.duration))
                gone |= {lo + k: (int(part["t"].iloc[k]), *c) for k, c in zip(dropped, costs, strict=True)}
            cost = [None if k not in gone else dict(zip(("t", "worth", "strength", "stretch", "place"), gone[k], strict=True)) for k in range(len(found))]
            yield found[["series", "t", "worth", "strength", "duration", "max_gap", "block", "place"]].assign(cost=pd.Series(cost, index=found.index, dtype=object), fresh=[k in gone for k in range(len(found))])

    dropped = None
    while True:
        of_block = Window.partitionBy("series", "block").orderBy("t")
        # what a moment would cost with the neighbours that it has now
        near = scans.lagged(state, F.col("block"), ["t"], ["t"]).withColumn("low_", F.coalesce("before_.t", F.lit(0))).drop("before_")
        placed = near.withColumn("next_", F.lead("t").over(of_block))
        outer = placed.groupBy("series", "block", "duration").agg(F.min_by(F.struct("t", "worth", "strength", "place", "low_", "next_"), "t").alias("f"), F.max_by(F.struct("t", "worth", "strength", "place", "low_"), "t").alias("l"))
        by_block = Window.partitionBy("series").orderBy("block")
        following = outer.withColumn("start_", F.lead("f.t").over(by_block))
        as_edge = lambda e, nxt: F.struct(e["t"].alias("t"), e["worth"].cast("int").alias("worth"), e["strength"].alias("strength"), (nxt - e["low_"]).cast("bigint").alias("stretch"), e["place"].cast("bigint").alias("place"))
        beyond = F.coalesce(F.col("start_"), F.col("duration"))
        faces = following.select("series", "block", as_edge(F.col("f"), F.coalesce(F.col("f.next_"), beyond)).alias("f"), as_edge(F.col("l"), beyond).alias("l"))
        faces = faces.select("series", "block", F.lag("l").over(by_block).alias("before"), F.lead("f").over(by_block).alias("after"))
        done = cut(scans.given(state, faces, ["series", "block"], ["t"]).mapInPandas(round_, told))
        now = done.filter("fresh").select("series", "t", "cost")
        dropped = now if dropped is None else dropped.unionByName(now)
        if done.filter("fresh").isEmpty() or state.select("series", "block").distinct().groupBy("series").count().filter("count > 1").isEmpty():
            break
        state = done.filter("not fresh").drop("cost", "fresh")
    cheapest = Window.partitionBy("series").orderBy("cost.worth", "cost.strength", "cost.stretch", "cost.place")
    gone = dropped.withColumn("n_", F.row_number().over(cheapest)).join(over, "series").filter(F.col("n_") <= F.col("over_")).select("series", "t")
    return moments.join(gone, ["series", "t"], "left_anti").select("series", "t", "reason", "change")
