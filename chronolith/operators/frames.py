"""Picture change of frames kept as flat arrays of pixels: ``series, i, pixels``.

Cells are a grid of ``rows`` by ``cols`` over ``height`` by ``width`` pixels, with floor
split edges, so that cells may differ in size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans

#: fixed values: how many times its own median a cell has to exceed; noise of a masked cell
BASELINE_FACTOR = 4.0
NOISY = 0.005
GRID = 3


def cell_bounds(size: int, parts: int = GRID) -> list[tuple[int, int]]:
    return [(size * k // parts, size * (k + 1) // parts) for k in range(parts)]


def cell_places(height: int, width: int, rows: int = GRID, cols: int = GRID) -> list[list[int]]:
    """Pixels of each cell, row by row."""
    return [[y * width + x for y in range(*r) for x in range(*c)] for r in cell_bounds(height, rows) for c in cell_bounds(width, cols)]


def thumbnail(pixels: Column, height: int, width: int, to_height: int, to_width: int) -> Column:
    """Nearest pixels of a smaller frame."""
    places = [(y * height // to_height) * width + x * width // to_width for y in range(to_height) for x in range(to_width)]
    return F.array(*[F.element_at(pixels, p + 1) for p in places])


def changed(frames: DataFrame, delta: float) -> DataFrame:
    """Adds ``moved``, a flag for each pixel that differs by more than ``delta`` from the frame before; all of the first frame."""
    rows = scans.lagged(frames, scans.block_of(F.col("i")), ["i"], ["pixels"])
    flags = F.zip_with("pixels", "before_.pixels", lambda a, b: (F.abs(a - b) > delta).cast("int"))
    return rows.withColumn("moved", F.when(F.col("before_").isNull(), F.transform("pixels", lambda _: F.lit(1))).otherwise(flags)).drop("before_")


def cell_counts(moved: Column, cells: list[list[int]]) -> Column:
    """Pixels that moved in each cell."""
    one = lambda places: F.aggregate(F.transform(F.array(*[F.lit(p + 1) for p in places]), lambda p: F.element_at(moved, p)), F.lit(0), lambda a, b: a + b)
    return F.array(*[one(c) for c in cells])


def cell_change(frames: DataFrame, delta: float, height: int, width: int) -> DataFrame:
    """``series, i, cells`` (shares of each cell's pixels), ``n_moved`` and ``change_global`` (of the whole frame)."""
    cells = cell_places(height, width)
    counts = changed(frames, delta).withColumn("counts", cell_counts(F.col("moved"), cells))
    shares = F.zip_with("counts", F.array(*[F.lit(float(len(c))) for c in cells]), lambda n, size: n / size)
    n = F.aggregate("counts", F.lit(0), lambda a, b: a + b)
    return counts.select("series", "i", "counts", shares.alias("cells"), n.alias("n_moved"), (n / F.lit(float(height * width))).alias("change_global"))


def baselines(cells: DataFrame) -> DataFrame:
    """``series, baseline``: the median of each cell over time, in order of cells."""
    long = scans.medians(cells.select("series", F.posexplode("cells").alias("cell", "share")), ["series", "cell"], "share", "base")
    return long.groupBy("series").agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "base"))), lambda x: x["base"]).alias("baseline"))


def excess(cells: DataFrame, factor: float = BASELINE_FACTOR, base: DataFrame | None = None) -> DataFrame:
    """Adds ``change``: the most that any cell exceeds its own baseline (``base``, if it is known already), between 0 and 1."""
    over = F.array_max(F.zip_with("cells", "baseline", lambda c, b: c - b * factor))
    return cells.join(baselines(cells) if base is None else base, "series").withColumn("change", F.greatest(F.lit(0.0), F.least(F.lit(1.0), over))).drop("baseline")


def screen_distance(a: Column, b: Column, baseline: Column, cell_of: list[int], delta: float, noisy: float = NOISY) -> Column:
    """Share of pixels that differ by more than ``delta`` outside noisy cells; of all pixels if every cell is noisy."""
    quiet = F.transform(F.array(*[F.lit(c + 1) for c in cell_of]), lambda c: F.element_at(baseline, c) <= noisy)
    differs = F.zip_with(a, b, lambda x, y: F.abs(x - y) > delta)
    n_quiet = F.size(F.filter(quiet, lambda q: q))
    seen = F.when(n_quiet == 0, F.transform(quiet, lambda _: F.lit(True))).otherwise(quiet)
    hits = F.size(F.filter(F.zip_with(differs, seen, lambda d, s: d & s), lambda h: h))
    return hits / F.size(F.filter(seen, lambda s: s))
