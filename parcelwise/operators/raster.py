"""Rasters as long tables (i, j, value)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import order_statistics, share_under


def cell_of(x: Column, y: Column, x0: float, y0: float, dx: float, dy: float) -> tuple[Column, Column]:
    """Row and column of a coordinate."""
    return F.floor((y - y0) / dy), F.floor((x - x0) / dx)


def mosaic(*tiles: DataFrame) -> DataFrame:
    """United tiles; of cells in several tiles one stays."""
    out = tiles[0]
    for t in tiles[1:]:
        out = out.unionByName(t)
    return out.dropDuplicates(["i", "j"])


def sample(points: DataFrame, cells: DataFrame, i: Column, j: Column, name: str = "value") -> DataFrame:
    """Value of the cell that each point lies in; outside null."""
    on = points.withColumns({"__i": i, "__j": j})
    c = cells.select(F.col("i").alias("__ci"), F.col("j").alias("__cj"), F.col("value").alias(name))
    return on.join(c, (F.col("__i") == F.col("__ci")) & (F.col("__j") == F.col("__cj")), "left").drop("__i", "__j", "__ci", "__cj")


#: Rows and columns of a block.
BLOCK = 256


def windowed(cells: DataFrame, column: str, reach: int, run: Callable[[np.ndarray, np.ndarray, int], pd.DataFrame], schema: str) -> DataFrame:
    """Windows over a raster in blocks of BLOCK x BLOCK cells, each with a border of ``reach`` cells around.

    A cell goes to its block, and those near an edge to the neighbours too, so that the
    shuffle is little more than the table. run gets a block's values (a list of objects for its rows, numbers
    into it as a square array with -1 for missing cells) and the width of the border; it gives rows
    with i and j counted from the block's corner. Cells without i or j take no part, and of
    rows that repeat a cell one counts; null values come as they are.
    """
    targets = lambda c: F.sequence(F.floor((F.col(c) - reach) / BLOCK), F.floor((F.col(c) + reach) / BLOCK))
    sent = cells.where("i is not null and j is not null").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col(column).alias("v"))
    sent = sent.withColumn("bi", F.explode(targets("i"))).withColumn("bj", F.explode(targets("j")))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(pdf["bi"].iloc[0]) * BLOCK, int(pdf["bj"].iloc[0]) * BLOCK
        at = np.full((BLOCK + 2 * reach, BLOCK + 2 * reach), -1)
        at[pdf["i"].to_numpy() - bi + reach, pdf["j"].to_numpy() - bj + reach] = np.arange(len(pdf))
        out = run(pdf["v"].to_numpy(), at, reach)
        return out.assign(i=out["i"] + bi, j=out["j"] + bj)

    return sent.groupBy("bi", "bj").applyInPandas(block, schema)


def _shifted(a: np.ndarray, reach: int, di: int, dj: int) -> np.ndarray:
    """For each cell of the block the cell at an offset."""
    n = len(a) - 2 * reach
    return a[reach + di : reach + di + n, reach + dj : reach + dj + n]


def _reach(offsets: list[tuple]) -> int:
    return max([1, *(max(abs(o[0]), abs(o[1])) for o in offsets)])


def focal_mean(cells: DataFrame, offsets: list[tuple[int, int, float]]) -> DataFrame:
    """Weighted mean over the offsets that exist, for cells that exist; null and missing cells have no weight.

    Cells whose neighbours have no weight in all have no row.
    """

    def run(v: np.ndarray, at: np.ndarray, reach: int) -> pd.DataFrame:
        value = np.where(at >= 0, v[at].astype(float), np.nan)
        there = ~np.isnan(value)
        total, weight = (sum(w * _shifted(a, reach, di, dj) for di, dj, w in offsets) for a in (np.where(there, value, 0.0), there.astype(float)))
        i, j = np.nonzero((weight != 0) & (_shifted(at, reach, 0, 0) >= 0))
        return pd.DataFrame({"i": i, "j": j, "value": total[i, j] / weight[i, j]})

    return windowed(cells, "value", _reach(offsets), run, "i long, j long, value double")


def focal_median(cells: DataFrame, radius: float, size: float) -> DataFrame:
    """Median within a circle; null and missing cells are left out."""
    k = int(radius // size)
    round_ = [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1) if math.hypot(a, b) * size <= radius]

    def run(v: np.ndarray, at: np.ndarray, reach: int) -> pd.DataFrame:
        value = np.where(at >= 0, v[at].astype(float), np.nan)
        rows = []
        for top in range(0, BLOCK, 32):  # a strip at a time bounds the stack of shifts
            strip = value[top : top + 32 + 2 * reach]
            n = len(strip) - 2 * reach
            stack = np.sort(np.stack([strip[reach + a : reach + a + n, reach + b : reach + b + BLOCK] for a, b in round_]), axis=0)
            count = (~np.isnan(stack)).sum(0)
            low, high = (np.take_along_axis(stack, np.maximum(m, 0)[None], 0)[0] for m in ((count - 1) // 2, count // 2 - (count == 0)))
            i, j = np.nonzero((count > 0) & (at[reach + top : reach + top + n, reach : reach + BLOCK] >= 0))
            rows.append(pd.DataFrame({"i": i + top, "j": j, "value": (low[i, j] + high[i, j]) / 2}))
        return pd.concat(rows)

    return windowed(cells, "value", max(1, k), run, "i long, j long, value double")


def gaussian_mask(sd: float, size: float, reach: float = 5.0) -> list[tuple[int, int, float]]:
    """Square window of weights that sum to 1 over the whole mask."""
    k = math.ceil(reach * sd / size)
    raw = [(a, b, math.exp(-((a * size) ** 2 + (b * size) ** 2) / (2 * sd * sd))) for a in range(-k, k + 1) for b in range(-k, k + 1)]
    total = sum(w for *_, w in raw)
    return [(a, b, w / total) for a, b, w in raw]


def _convolved(a: np.ndarray, mask: list[tuple[int, int, float]], reach: int) -> np.ndarray:
    """Weighted sums of the cells at the mask's offsets; in two passes where the mask is a row times a column."""
    w = np.zeros((2 * reach + 1, 2 * reach + 1))
    for di, dj, x in mask:
        w[di + reach, dj + reach] += x
    middle = w[reach, reach]
    if middle and np.allclose(np.outer(w[:, reach], w[reach]) / middle, w, rtol=1e-12, atol=0):
        n = len(a) - 2 * reach
        rows = sum(w[reach + d, reach] * a[reach + d : reach + d + n] for d in range(-reach, reach + 1))
        return sum(w[reach, reach + d] / middle * rows[:, reach + d : reach + d + n] for d in range(-reach, reach + 1))
    return sum(x * _shifted(a, reach, di, dj) for di, dj, x in mask)


def neighbour_sums(cells: DataFrame, mask: list[tuple[int, int, float]], category: str) -> DataFrame:
    """(i, j, category, w): weight of each category around each place; at edges the mask is cut, not rescaled.

    Weights are positive. A category has rows wherever a cell of it is in reach; null is none.
    """
    cells = cells.where(F.col(category).isNotNull())
    kind = cells.schema[category].dataType.simpleString()

    def run(v: np.ndarray, at: np.ndarray, reach: int) -> pd.DataFrame:
        codes, names = pd.factorize(v)
        code = np.where(at >= 0, codes[at], -1)
        rows = [pd.DataFrame({"i": [], "j": [], category: [], "w": []})]
        for c, name in enumerate(names):
            w = _convolved((code == c).astype(float), mask, reach)
            i, j = np.nonzero(w > 0)
            rows.append(pd.DataFrame({"i": i, "j": j, category: [name] * len(i), "w": w[i, j]}))
        return pd.concat(rows)

    return windowed(cells, category, _reach(mask), run, f"i long, j long, {category} {kind}, w double")


def gradients(cells: DataFrame, size: float) -> DataFrame:
    """(i, j, dzdx, dzdy) by Horn's 3 x 3 window, for cells with all eight neighbours. i grows to the north, j to the east."""
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]

    def run(v: np.ndarray, at: np.ndarray, reach: int) -> pd.DataFrame:
        value = np.where(at >= 0, v[at].astype(float), np.nan)
        z = {o: _shifted(value, reach, *o) for o in around}
        full = ~np.isnan(sum(z.values()))
        east, west = (z[-1, b] + 2 * z[0, b] + z[1, b] for b in (1, -1))
        north, south = (z[a, -1] + 2 * z[a, 0] + z[a, 1] for a in (1, -1))
        i, j = np.nonzero(full)
        return pd.DataFrame({"i": i, "j": j, "dzdx": ((east - west) / (8 * size))[i, j], "dzdy": ((north - south) / (8 * size))[i, j]})

    return windowed(cells, "value", 1, run, "i long, j long, dzdx double, dzdy double")


def terrain(cells: DataFrame, size: float) -> DataFrame:
    """(i, j, slope, aspect, westness, southness): degrees; flat cells have aspect -1."""
    g = gradients(cells, size)
    slope = F.degrees(F.atan(F.hypot("dzdx", "dzdy")))
    flat = (F.col("dzdx") == 0) & (F.col("dzdy") == 0)
    aspect = F.when(flat, -1.0).otherwise(F.pmod(F.degrees(F.atan2(-F.col("dzdx"), -F.col("dzdy"))), F.lit(360.0)))
    g = g.select("i", "j", slope.alias("slope"), aspect.alias("aspect"))
    west = F.abs(F.pmod(F.col("aspect") + 90, F.lit(360.0)) - 180) / 180
    return g.withColumns({"westness": west, "southness": 1 - F.abs(F.col("aspect") - 180) / 180})


def value_percentiles(cells: DataFrame, samples: int = 1000) -> DataFrame:
    """``cells`` with percentile: the share of breakpoints (at 0, 1/samples, ... of all cells) that lie under each value.

    The breakpoints are exact order statistics, found by counting; they alone reach the driver. Null values have none.
    """
    at = tuple(k / samples for k in range(samples))
    found = order_statistics(cells.select(F.lit(0).alias("g"), "value"), "g", "value", at).get(0)
    breaks = [found[q] for q in at] if found else [0.0]
    return cells.withColumn("percentile", share_under(F.col("value").cast("double"), breaks))


def validate(a: DataFrame, b: DataFrame, nodata: float | None = None) -> DataFrame:
    """(i, j, model, real): cells of two rasters that both have data."""
    ok = lambda c: F.col(c).isNotNull() & (F.col(c) != nodata if nodata is not None else F.lit(True))
    return a.select("i", "j", F.col("value").alias("model")).join(b.select("i", "j", F.col("value").alias("real")), ["i", "j"]).where(ok("model") & ok("real"))
