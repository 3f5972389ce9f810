"""Spatial joins on square bins.

A bin's side is the search range (or about a bounding box). Each object stands in every
bin that its buffered box touches; a pair met in several bins counts only in the bin of
the greater of both lower corners, so no distinct is needed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import crosses, signed_area
from .network import kept


def bin_of(x: Column, side: float) -> Column:
    return F.floor(x / side)


def _around(df: DataFrame, x: str, y: str, side: float) -> DataFrame:
    """A row for each of the 3 x 3 bins around the point."""
    cells = F.explode(F.array(*(F.struct((bin_of(F.col(x), side) + i).alias("bx"), (bin_of(F.col(y), side) + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    return df.withColumn("__c", cells).select("*", "__c.bx", "__c.by").drop("__c")


#: Points of the left side in one bin beyond which the bin is split.
DENSE = 50_000


def within_range(left: DataFrame, right: DataFrame, radius: float, lx: str = "x", ly: str = "y", rx: str = "px", ry: str = "py", dense: int = DENSE) -> DataFrame:
    """Pairs no farther apart than ``radius``, with ``distance``; ``right`` should be the smaller side.

    Bins are as wide as the radius. Bins with more than ``dense`` points of ``left`` are dealt to
    several tasks, each with the right side's points of the bin, so that a crowded place isn't one task.
    """
    a = left.withColumns({"bx": bin_of(F.col(lx), radius), "by": bin_of(F.col(ly), radius)})
    b = _around(right, rx, ry, radius)
    crowded = kept(a.groupBy("bx", "by").agg(F.ceil(F.count(F.lit(1)) / dense).alias("__parts")).where("__parts > 1"))
    on = ["bx", "by"]
    if not crowded.isEmpty():
        parts = F.coalesce("__parts", F.lit(1))
        a = a.withColumn("__n", F.monotonically_increasing_id()).join(crowded, on, "left").withColumn("__s", F.pmod("__n", parts)).drop("__parts", "__n")
        b = b.join(crowded, on, "left").withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts")
        on = [*on, "__s"]
    out = a.join(b, on).withColumn("distance", F.hypot(F.col(lx) - F.col(rx), F.col(ly) - F.col(ry)))
    return out.where(F.col("distance") <= radius).drop(*on)


def gaussian_weight(distance: Column, sd: float) -> Column:
    return F.exp(-distance * distance / (2 * sd * sd))


def gaussian_sums(targets: DataFrame, points: DataFrame, sd: float, key: str, value: str, px: str = "px", py: str = "py") -> DataFrame:
    """(key, n, wsum, wmean): points within 5 sd of each target, weighted by distance.

    Points of one place are one with their number and sum, and targets of one place meet them once.
    Pairs are summed where they are joined.
    """
    some = points.groupBy(px, py).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"))
    near = within_range(targets.select("x", "y").distinct(), some, 5 * sd, rx=px, ry=py).withColumn("w", gaussian_weight(F.col("distance"), sd))
    sums = near.groupBy("x", "y").agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.col("w")).alias("wsum"), F.sum(F.col("n") * F.col("w")).alias("w"))
    each = targets.select(key, "x", "y").join(sums, ["x", "y"]).groupBy(key).agg(*(F.sum(c).alias(c) for c in ("n", "wsum", "w")))
    return each.select(key, "n", "wsum", F.try_divide("wsum", "w").alias("wmean"))


def nearest(left: DataFrame, right: DataFrame, radius: float, key: str, other: str, lx: str = "x", ly: str = "y", rx: str = "px", ry: str = "py") -> DataFrame:
    """(key, other, distance): the nearest of ``right`` within ``radius``; ties go to the least id.

    Rows of one place meet the others once, and of the right side's the least id alone.
    """
    least = right.groupBy(rx, ry).agg(F.min(other).alias("o"))
    near = within_range(left.select(lx, ly).distinct(), least, radius, lx, ly, rx, ry)
    found = near.groupBy(lx, ly).agg(F.min(F.struct("distance", "o")).alias("b"))
    best = left.select(key, lx, ly).join(found, [lx, ly]).groupBy(key).agg(F.min("b").alias("b"))
    return best.select(key, F.col("b.o").alias(other), F.col("b.distance").alias("distance"))


def edges_of(polygons: DataFrame, key: str, rings: str = "rings", *more: str) -> DataFrame:
    """(key, more, r, i, x1, y1, x2, y2) of all rings, holes too; r and i are places of the ring and of the edge's first end."""
    points = polygons.select(key, *more, F.posexplode(rings).alias("r", "__ring")).select(key, *more, "r", F.size("__ring").alias("__n"), "__ring", F.posexplode("__ring").alias("i", "__p"))
    q = F.element_at("__ring", F.when(F.col("i") == F.col("__n") - 1, 1).otherwise(F.col("i") + 2))
    return points.select(key, *more, "r", "i", F.col("__p.x").alias("x1"), F.col("__p.y").alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))


def shape_id(rings: str | Column) -> Column:
    """A name of 128 bits that equal rings share."""
    return F.struct(F.xxhash64(rings).alias("a"), F.xxhash64(F.lit(1), rings).alias("b"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, key: str, other: str, side: float, x: str = "x", y: str = "y", rings: str = "rings") -> DataFrame:
    """(key, other) of points inside polygons: edges crossed to the right, an odd number.

    Points of one place and polygons of equal rings meet once, and the pairs found are spread to their rows.
    Places meet polygons by the square cells that a polygon's box covers, then only the edges of
    that polygon in the place's band of y. Rings aren't copied to cells, and holes toggle by
    themselves. Null or empty rings hold nothing. Repeated rows count once; rows of one key that
    differ are points or polygons of their own, and a pair of keys has one row if any of them meet.
    """
    lo, hi = (lambda c, f: f(F.transform("pts", lambda p: p[c]))), lambda v: F.floor(v / side)
    named = polygons.select(F.col(other).alias("o"), shape_id(rings).alias("s"), F.col(rings).alias("rings"))
    shapes = named.select("s", "rings").dropDuplicates(["s"])
    boxes = shapes.select("s", F.flatten("rings").alias("pts")).where(F.size("pts") > 0)
    boxes = boxes.select("s", lo("x", F.array_min).alias("x1"), lo("x", F.array_max).alias("x2"), lo("y", F.array_min).alias("y1"), lo("y", F.array_max).alias("y2"))
    cells = boxes.withColumn("bx", F.explode(F.sequence(hi(F.col("x1")), hi(F.col("x2"))))).withColumn("by", F.explode(F.sequence(hi(F.col("y1")), hi(F.col("y2")))))
    rows = points.select(F.col(key).alias("k"), F.col(x).alias("px"), F.col(y).alias("py"))
    spots = rows.select("px", "py").distinct().withColumns({"bx": bin_of(F.col("px"), side), "by": bin_of(F.col("py"), side)})
    near = spots.join(cells.hint("merge"), ["bx", "by"]).where(F.col("px").between(F.col("x1"), F.col("x2")) & F.col("py").between(F.col("y1"), F.col("y2"))).select("px", "py", "s", "by")
    edges = edges_of(shapes, "s").where("y1 != y2")
    edges = edges.withColumn("by", F.explode(F.sequence(F.floor(F.least("y1", "y2") / side), F.floor(F.greatest("y1", "y2") / side))))
    hits = near.join(edges.hint("merge"), ["s", "by"]).where(crosses(F.col("px"), F.col("py"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    inside = hits.groupBy("px", "py", "s").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("px", "py", "s")
    # Repeated rows are one before the pairs are spread; then only keys of several rows can give a pair twice.
    held, owners = rows.distinct().join(inside.hint("merge"), ["px", "py"]), named.select("o", "s").distinct()
    several = held.groupBy("k").agg(F.countDistinct("px", "py").alias("n")).where("n > 1")
    parts = owners.groupBy("o").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = held.select("k", "s").distinct().join(owners.hint("merge"), "s").select(F.col("k").alias(key), F.col("o").alias(other))
    return found if several.isEmpty() and parts.isEmpty() else found.distinct()


def touching(left: DataFrame, right: DataFrame, pairs: DataFrame, key: str, anti: bool = False) -> DataFrame:
    """Rows of ``left`` whose key is (or, with ``anti``, isn't) in ``pairs``."""
    return left.join(pairs.select(key).distinct(), key, "left_anti" if anti else "left_semi")


# --- overlay ----------------------------------------------------------------------


def triangle_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas that pairs of counter-clockwise triangles (n, 3, 2) share: one cut by the other's sides, all pairs at once."""
    poly = a - a[:, :1]
    knife = b - a[:, :1]
    alive = np.ones(len(a), bool)
    for k in range(3):
        p, v = knife[:, k, None], (knife[:, (k + 1) % 3] - knife[:, k])[:, None]
        d = v[..., 0] * (poly[..., 1] - p[..., 1]) - v[..., 1] * (poly[..., 0] - p[..., 0])
        after, dn = np.roll(poly, -1, 1), np.roll(d, -1, 1)
        crossed = d * dn < 0
        share = np.where(crossed, d / np.where(crossed, d - dn, 1.0), 0.0)
        # Slots: each corner, then the crossing after it; empty slots repeat the corner before, which adds no area.
        points = np.stack([poly, poly + share[..., None] * (after - poly)], 2).reshape(len(a), -1, 2)
        full = np.stack([d >= 0, crossed], 2).reshape(len(a), -1)
        alive &= full.any(1)
        at = np.maximum.accumulate(np.where(full, np.arange(full.shape[1]), -1), 1)
        last = at[:, -1:]
        poly = np.take_along_axis(points, np.maximum(np.where(at < 0, last, at), 0)[..., None], 1)
    x, y = poly[..., 0], poly[..., 1]
    area = (x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1) / 2
    return np.where(alive, np.maximum(area, 0.0), 0.0)


def triangles(polygons: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """(key, t, sign): triangles t (x1, y1, x2, y2, x3, y3), counter-clockwise, whose areas by sign add up to each polygon.

    Each ring is a fan around its first corner; triangles that the ring runs around the other
    way, and those of holes, have sign -1. That holds for concave rings too, with no search for ears.
    """
    fans = polygons.select(key, F.posexplode(rings).alias("r", "ring")).where(F.size("ring") > 2)
    fans = fans.select(key, F.when((F.col("r") == 0) == (signed_area(F.col("ring")) > 0), 1).otherwise(-1).alias("turn"), "ring", F.explode(F.sequence(F.lit(2), F.size("ring") - 1)).alias("i"))
    p, q, w = (F.element_at("ring", k) for k in (F.lit(1), F.col("i"), F.col("i") + 1))
    x = lambda c: c["x"].cast("double")
    y = lambda c: c["y"].cast("double")
    cross = (x(q) - x(p)) * (y(w) - y(p)) - (y(q) - y(p)) * (x(w) - x(p))
    rows = fans.select(key, "turn", cross.alias("cross"), F.array(x(p), y(p), x(q), y(q), x(w), y(w)).alias("t")).where("cross != 0")
    flipped = F.array(*(F.col("t")[k] for k in (0, 1, 4, 5, 2, 3)))
    return rows.select(key, F.when(F.col("cross") > 0, F.col("t")).otherwise(flipped).alias("t"), F.when(F.col("cross") > 0, F.col("turn")).otherwise(-F.col("turn")).alias("sign"))


def overlay(left: DataFrame, right: DataFrame, left_id: str, right_id: str, side: float, rings: str = "rings") -> DataFrame:
    """(left_id, right_id, piece_area): intersect overlay by areas; see ``parcels.clipped_polygons`` for shapes.

    Rings are ``array<array<struct<x, y>>>``. Polygons become triangles once, triangles meet in
    bins, and a pair's shared areas are summed by sign where they are made. Repeated rows count once;
    rows of one id that differ are parts of one polygon. Null and empty rings share nothing.
    """

    def binned(df: DataFrame, k: str, tag: str) -> DataFrame:
        once = df.select(F.col(k).alias(f"{tag}_id"), F.col(rings).alias("rings"), F.xxhash64(rings).alias("h")).dropDuplicates([f"{tag}_id", "h"])
        t = triangles(once, f"{tag}_id").withColumnRenamed("t", tag).withColumnRenamed("sign", f"{tag}_sign")
        ends = lambda f, o: f(*(F.col(tag)[o + 2 * i] for i in range(3)))
        t = t.withColumns({f"{tag}{n}{m}": ends(f, o) for n, o in (("x", 0), ("y", 1)) for m, f in ((0, F.least), (1, F.greatest))})
        span = lambda n: F.sequence(F.floor(F.col(f"{tag}{n}0") / side), F.floor(F.col(f"{tag}{n}1") / side))
        return t.withColumn("bx", F.explode(span("x"))).withColumn("by", F.explode(span("y")))

    pairs = binned(left, left_id, "a").join(binned(right, right_id, "b"), ["bx", "by"]).where("ax0 < bx1 and bx0 < ax1 and ay0 < by1 and by0 < ay1")
    pairs = pairs.where((F.col("bx") == F.floor(F.greatest("ax0", "bx0") / side)) & (F.col("by") == F.floor(F.greatest("ay0", "by0") / side)))

    @F.pandas_udf("double")
    def area(a: pd.Series, b: pd.Series) -> pd.Series:
        t, u = (np.stack(s.to_list()).reshape(-1, 3, 2) if len(s) else np.zeros((0, 3, 2)) for s in (a, b))
        return pd.Series(triangle_areas(t, u))

    each = pairs.select("a_id", "b_id", (area("a", "b") * F.col("a_sign") * F.col("b_sign")).alias("s"))
    sums = each.groupBy(F.col("a_id").alias(left_id), F.col("b_id").alias(right_id)).agg(F.sum("s").alias("piece_area"))
    return sums.where("piece_area > 1e-9")


def identity(left: DataFrame, pieces: DataFrame, left_id: str, right_id: str, area: str) -> DataFrame:
    """``pieces`` and, for each of ``left`` with area left over, a piece with right id -1."""
    used = pieces.groupBy(left_id).agg(F.sum("piece_area").alias("__u"))
    rest = left.join(used, left_id, "left").withColumn("piece_area", F.col(area) - F.coalesce("__u", F.lit(0.0))).where("piece_area > 1e-9")
    return pieces.select(left_id, right_id, "piece_area").unionByName(rest.select(left_id, F.lit(-1).cast(pieces.schema[right_id].dataType).alias(right_id), "piece_area"))


def grid(x0: float, y0: float, x1: float, y1: float, step: float, spark) -> DataFrame:
    """(i, j, x, y): regular points centred in an extent."""
    nx, ny = max(1, int((x1 - x0) // step)), max(1, int((y1 - y0) // step))
    ox, oy = x0 + (x1 - x0 - (nx - 1) * step) / 2, y0 + (y1 - y0 - (ny - 1) * step) / 2
    cells = spark.range(nx * ny).select((F.col("id") % nx).alias("i"), F.floor(F.col("id") / nx).alias("j"))
    return cells.select("i", "j", (F.lit(ox) + F.col("i") * step).alias("x"), (F.lit(oy) + F.col("j") * step).alias("y"))


def tiles(extent: DataFrame, longest: float) -> DataFrame:
    """(xmin, ymin, xmax, ymax) boxes that cut each extent row in ceil(w / longest) x ceil(h / longest)."""
    nx, ny = (F.greatest(F.ceil((F.col(f"{a}max") - F.col(f"{a}min")) / longest), F.lit(1)) for a in "xy")
    rows = extent.select("*", nx.alias("nx"), ny.alias("ny")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)))
    w, h = (F.col("xmax") - F.col("xmin")) / F.col("nx"), (F.col("ymax") - F.col("ymin")) / F.col("ny")
    return rows.select("i", "j", (F.col("xmin") + F.col("i") * w).alias("x0"), (F.col("ymin") + F.col("j") * h).alias("y0"), (F.col("xmin") + (F.col("i") + 1) * w).alias("x1"), (F.col("ymin") + (F.col("j") + 1) * h).alias("y1"))


def convex(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise from the least point; points on its edges aren't part of it."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def half(points):
        out = []
        for c in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(c)
        return out[:-1]

    return half(p) + half(p[::-1])


def hull(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(ord, x, y) of the convex hull, counter-clockwise: hulls of partitions, then one of those."""

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = convex(list(zip(pdf["x"], pdf["y"], strict=True)))
        return pd.DataFrame({"ord": range(len(ring)), "x": [a for a, _ in ring], "y": [b for _, b in ring]})

    def local(batches):
        for pdf in batches:
            if len(pdf):
                yield chain(pdf)

    first = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).mapInPandas(local, "ord int, x double, y double")
    return first.select(F.lit(0).alias("g"), "x", "y").groupBy("g").applyInPandas(chain, "ord int, x double, y double")


def _hull_centre(rings: list[list[tuple[float, float]]]) -> tuple[float, float]:
    """Area-weighted centroid of the rings' convex hulls; the mean of their vertices if they have no area."""
    total, sums = 0.0, np.zeros(2)
    for ring in rings:
        h = np.array(convex(ring))
        if len(h) > 2:
            o = h[0]
            u, v = h[1:-1] - o, h[2:] - o
            area = (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) / 2
            total, sums = total + area.sum(), sums + (area[:, None] * (o + (u + v) / 3)).sum(0)
    if total > 0:
        return tuple(sums / total)
    return tuple(np.mean([p for r in rings for p in r], 0))


def representative(kind: Column, parts: Column) -> Column:
    """A point struct (x, y) for a geometry of parts, rings and vertices; null if it has no vertex.

    Points stand for themselves, several for their mean; lines have their middle vertex, of all
    lines in order; polygons the area-weighted centroid of the hulls of their outer rings.
    """
    all_points = F.filter(F.flatten(F.flatten(parts)), lambda p: p.isNotNull())
    n = F.size(all_points)
    mean = lambda a: F.aggregate(all_points, F.lit(0.0), lambda s, p: s + p[a]) / n

    @F.pandas_udf("x double, y double")
    def centre(outer: pd.Series) -> pd.DataFrame:
        done = [(None, None) if r is None else _hull_centre([[(p["x"], p["y"]) for p in ring] for ring in r]) for r in outer]
        return pd.DataFrame(done, columns=["x", "y"], dtype=float)

    outer = F.when(kind.endswith("Polygon") & (n > 0), F.transform(F.filter(parts, lambda p: F.size(p) > 0), lambda p: F.element_at(p, 1)))
    of = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))
    return F.when(n > 0, F.when(kind.endswith("Point"), F.struct(mean("x").alias("x"), mean("y").alias("y"))).when(kind.endswith("LineString"), of(F.element_at(all_points, F.floor(n / 2).cast("int") + 1))).otherwise(centre(outer)))


def ranked(near: DataFrame, key: str, other: str, n: int) -> DataFrame:
    """The ``n`` nearest of ``within_range`` pairs for each key."""
    rank = F.row_number().over(W.partitionBy(key).orderBy("distance", other))
    return near.withColumn("rank", rank).where(F.col("rank") <= n)
