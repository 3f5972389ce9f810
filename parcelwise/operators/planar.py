"""Planar faces: edges cut where they meet, and the polygons that they bound.

``noded`` cuts edge tables of any size by joins on bins. ``faces`` walks the edges of one
polygon or pair of polygons (numpy, inside a task).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import side as side_of

#: Coordinates are rounded to so many digits, and points this near to an edge lie on it.
DIGITS, TOLERANCE = 6, 2e-6

Polygon = list[np.ndarray]


def after(a: np.ndarray) -> np.ndarray:
    """Each corner's next one."""
    return np.concatenate([a[1:], a[:1]])


def before(a: np.ndarray) -> np.ndarray:
    return np.concatenate([a[-1:], a[:-1]])


def ring_area(ring: np.ndarray) -> float:
    """Signed: positive if counter-clockwise."""
    x, y = (ring - ring[0]).T
    return float((x * after(y) - after(x) * y).sum() / 2)


def area_of(polygon: Polygon) -> float:
    return abs(ring_area(polygon[0])) - sum(abs(ring_area(h)) for h in polygon[1:])


def edges_of(rings: Polygon) -> np.ndarray:
    """(n, 4) edges of rings, closed or not."""
    return np.concatenate([np.concatenate([r, after(r)], 1) for r in rings]) if rings else np.zeros((0, 4))


def inside(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Whether each point (n, 2) lies within the rings that the edges make: an odd number crossed to the right, as ``geometry.crosses`` has it."""
    x, y = points[:, :1], points[:, 1:]
    x1, y1, x2, y2 = edges.T
    level = (np.minimum(y1, y2) < y) & (y <= np.maximum(y1, y2))
    at = x1 + (y - y1) / np.where(y1 == y2, 1.0, y2 - y1) * (x2 - x1)
    return (level & (at >= x)).sum(1) % 2 == 1


def inner_point(polygon: Polygon) -> tuple[float, float]:
    """The middle of the widest span on a scan line through the largest gap between vertices' heights."""
    e = edges_of(polygon)
    levels = np.unique(e[:, 1])
    gap = int(np.diff(levels).argmax()) if len(levels) > 1 else 0
    y = (levels[gap] + levels[min(gap + 1, len(levels) - 1)]) / 2
    x1, y1, x2, y2 = e[(np.minimum(e[:, 1], e[:, 3]) < y) & (y <= np.maximum(e[:, 1], e[:, 3]))].T
    at = np.sort(x1 + (y - y1) / (y2 - y1) * (x2 - x1))
    if len(at) < 2:
        return float(polygon[0][:, 0].mean()), float(y)
    k = int((at[1::2] - at[::2][: len(at) // 2]).argmax()) * 2
    return float((at[k] + at[k + 1]) / 2), float(y)


def _pieces(e: np.ndarray, owner: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Edges cut at points (owner: the number of the edge)."""
    n = len(e)
    owner = np.concatenate([np.arange(n), np.arange(n), owner])
    points = np.concatenate([e[:, :2], e[:, 2:], points])
    d = e[owner, 2:] - e[owner, :2]
    t = ((points - e[owner, :2]) * d).sum(1)
    order = np.lexsort((t, owner))
    owner, points = owner[order], points[order]
    same = owner[1:] == owner[:-1]
    return np.concatenate([points[:-1][same], points[1:][same]], 1)


def cut_edges(e: np.ndarray, block: int = 256) -> np.ndarray:
    """Edges (n, 4) cut wherever two of them cross, touch or overlap."""
    e = np.round(e, DIGITS)
    e = e[(e[:, :2] != e[:, 2:]).any(1)]
    low, high = np.minimum(e[:, :2], e[:, 2:]) - TOLERANCE, np.maximum(e[:, :2], e[:, 2:]) + TOLERANCE
    owners, points = [np.zeros(0, int)], [np.zeros((0, 2))]
    for at in range(0, len(e), block):
        i, j = np.nonzero((low[at : at + block, None] <= high[None]).all(2) & (high[at : at + block, None] >= low[None]).all(2))
        i = i + at
        i, j = i[i < j], j[i < j]
        a, b, c, d = e[i, :2], e[i, 2:], e[j, :2], e[j, 2:]
        on = np.zeros(len(i), bool)
        for p, q, r in ((a, c, d), (b, c, d), (c, a, b), (d, a, b)):
            v = r - q
            t = np.clip(((p - q) * v).sum(1) / (v * v).sum(1), 0, 1)
            near = np.hypot(*(q + t[:, None] * v - p).T) <= TOLERANCE
            on |= near
            owners += [i[near], j[near]]
            points += [p[near], p[near]]
        cross = lambda u, v: u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
        a1, a2, b1, b2 = cross(d - c, a - c), cross(d - c, b - c), cross(b - a, c - a), cross(b - a, d - a)
        proper = ~on & (a1 * a2 < 0) & (b1 * b2 < 0)
        p = np.round(a[proper] + (a1[proper] / (a1[proper] - a2[proper]))[:, None] * (b - a)[proper], DIGITS)
        owners += [i[proper], j[proper]]
        points += [p, p]
    return _pieces(e, np.concatenate(owners), np.concatenate(points))


def _walk(a: np.ndarray, b: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cycle, next) of each half-edge, the face on its left; half-edges 2k and 2k + 1 are an edge's two directions."""
    d = xy[b] - xy[a]
    order = np.lexsort((np.arctan2(d[:, 1], d[:, 0]), a))
    place = np.empty(len(a), int)
    place[order] = np.arange(len(a))
    start = np.searchsorted(a[order], np.arange(len(xy)))
    count = np.bincount(a, minlength=len(xy))
    twin = np.arange(len(a)) ^ 1
    onward = order[start[b] + (place[twin] - start[b] - 1) % count[b]].tolist()
    cycle = [-1] * len(a)
    for first in range(len(a)):
        h = first
        while cycle[h] < 0:
            cycle[h] = first
            h = onward[h]
    return np.array(cycle), np.array(onward)


def faces(edges: np.ndarray) -> list[Polygon]:
    """The bounded faces of cut edges (n, 4), each an outer ring (counter-clockwise) and holes.

    Edges that bound no face on one side (loose ends, bridges) go. Repeated edges count once.
    """
    e = np.round(edges, DIGITS) + 0.0
    xy, ids = np.unique(e.reshape(-1, 2), axis=0, return_inverse=True)
    pairs = np.sort(ids.reshape(-1, 2), axis=1)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    for _ in range(2):
        if not len(pairs):
            return []
        a, b = pairs.ravel(), pairs[:, ::-1].ravel()
        cycle, onward = _walk(a, b, xy)
        apart = cycle[::2] != cycle[1::2]
        pairs = pairs[apart]
        if apart.all():
            break
    shapes = []
    for first in np.flatnonzero(cycle == np.arange(len(a))).tolist():
        ring, h = [int(a[first])], int(onward[first])
        while h != first:
            ring.append(int(a[h]))
            h = int(onward[h])
        shapes.append(xy[ring])
    sizes = [ring_area(s) for s in shapes]
    outer = sorted((s, i) for i, s in enumerate(sizes) if s > 0)
    found = {i: [shapes[i]] for _, i in outer}
    box = {i: (shapes[i].min(0), shapes[i].max(0)) for _, i in outer}
    corners = {i: set(map(tuple, shapes[i].tolist())) for _, i in outer}
    for i in (i for i, s in enumerate(sizes) if s < 0):
        # A clockwise cycle is the outside of a group of faces: a hole of the least face around it that it doesn't touch.
        spot = shapes[i][:1]
        for s, k in outer:
            around = s > -sizes[i] and (box[k][0] <= spot[0]).all() and (spot[0] <= box[k][1]).all()
            if around and corners[k].isdisjoint(map(tuple, shapes[i].tolist())) and inside(spot, edges_of([shapes[k]]))[0]:
                found[k].append(shapes[i])
                break
    return list(found.values())


def shared(a: Polygon, b: Polygon) -> list[Polygon]:
    """The parts of polygon a that lie in polygon b."""
    ea, eb = edges_of(a), edges_of(b)
    if not len(ea) or not len(eb):
        return []
    parts = faces(cut_edges(np.concatenate([ea, eb])))
    if not parts:
        return []
    spots = np.array([inner_point(p) for p in parts])
    return [p for p, yes in zip(parts, inside(spots, ea) & inside(spots, eb), strict=True) if yes]


def polygons_of(column: pa.Array) -> list[Polygon]:
    """Polygons of an Arrow column of rings of points (x, y), without the repeated last corner; null and short rings go."""
    out = []
    for shape in column.to_pylist():
        rings = [np.array([[p["x"], p["y"]] for p in r if p is not None], float).reshape(-1, 2) for r in shape or [] if r is not None]
        rings = [r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in rings]
        out.append([r for r in rings if len(r) > 2])
    return out


def points_in(polygon: Polygon) -> list[list[dict]]:
    """The rings of a polygon as Arrow takes them."""
    return [[{"x": x, "y": y} for x, y in r.tolist()] for r in polygon]


#: Arrow's type of rings.
SHAPE = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


# --- edge tables --------------------------------------------------------------------


def _near(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The point lies on the edge."""
    dx, dy = x2 - x1, y2 - y1
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy)) <= TOLERANCE


def rounded(e: DataFrame) -> DataFrame:
    """Edges with coordinates of DIGITS digits; those without length go."""
    return e.withColumns({c: F.round(F.col(c).cast("double"), DIGITS) + 0.0 for c in ("x1", "y1", "x2", "y2")}).where("x1 != x2 or y1 != y2")


def meetings(e: DataFrame, f: DataFrame, size: float) -> DataFrame:
    """(eid, fid, px, py): where edges of e (eid, x1..y2) meet those of f (fid, ...): crossings, touches, ends of overlaps.

    Pairs come from bins and count in one of them; a point is worked out once for both edges. Neither side is
    broadcast, here and in ``pieces``: Spark takes tables of computed shapes for smaller than they are.
    """
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - TOLERANCE) / size), F.floor((F.greatest(a, b) + TOLERANCE) / size))
    binned = lambda d: d.withColumn("bx", F.explode(span("x1", "x2"))).withColumn("by", F.explode(span("y1", "y2")))
    other = binned(f).select("bx", "by", "fid", *(F.col(c).alias(f"f{c}") for c in ("x1", "y1", "x2", "y2")))
    low = lambda a: F.floor((F.greatest(F.least(f"{a}1", f"{a}2"), F.least(f"f{a}1", f"f{a}2")) - TOLERANCE) / size)
    over = lambda a: (F.least(f"{a}1", f"{a}2") <= F.greatest(f"f{a}1", f"f{a}2") + 2 * TOLERANCE) & (F.least(f"f{a}1", f"f{a}2") <= F.greatest(f"{a}1", f"{a}2") + 2 * TOLERANCE)
    pairs = binned(e).join(other.hint("merge"), ["bx", "by"]).where(over("x") & over("y") & (F.col("bx") == low("x")) & (F.col("by") == low("y")))
    a, b, c, d = ((F.col(f"{p}x{i}"), F.col(f"{p}y{i}")) for p in ("", "f") for i in (1, 2))
    ends = [F.when(_near(*p, *q, *r), F.struct(p[0].alias("px"), p[1].alias("py"))) for p, q, r in ((a, c, d), (b, c, d), (c, a, b), (d, a, b))]
    a1, a2, b1, b2 = side_of(*a, *c, *d), side_of(*b, *c, *d), side_of(*c, *a, *b), side_of(*d, *a, *b)
    t = F.try_divide(a1, a1 - a2)
    proper = F.when((a1 * a2 < 0) & (b1 * b2 < 0), F.struct(F.round(a[0] + t * (b[0] - a[0]), DIGITS).alias("px"), F.round(a[1] + t * (b[1] - a[1]), DIGITS).alias("py")))
    touched = F.array_compact(F.array(*ends))
    points = F.when(F.size(touched) > 0, touched).otherwise(F.array_compact(F.array(proper)))
    return pairs.select("eid", "fid", F.explode(points).alias("p")).select("eid", "fid", "p.px", "p.py")


def pieces(e: DataFrame, at: DataFrame) -> DataFrame:
    """Edges (eid, x1..y2) cut at points (eid, px, py): (eid, part, x1, y1, x2, y2), part from 0 along the edge."""
    points = at.groupBy("eid").agg(F.collect_set(F.struct("px", "py")).alias("ps"))
    rows = e.hint("merge").join(points.hint("merge"), "eid", "left")
    t = lambda p: (p["px"] - F.col("x1")) * (F.col("x2") - F.col("x1")) + (p["py"] - F.col("y1")) * (F.col("y2") - F.col("y1"))
    ends = F.array(F.struct(F.col("x1").alias("px"), F.col("y1").alias("py")), F.struct(F.col("x2").alias("px"), F.col("y2").alias("py")))
    way = F.array_sort(F.transform(F.array_distinct(F.concat(ends, F.coalesce("ps", F.array().cast("array<struct<px: double, py: double>>")))), lambda p: F.struct(t(p).alias("t"), p["px"].alias("px"), p["py"].alias("py"))))
    steps = rows.select("eid", way.alias("w")).select("eid", F.posexplode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("p"), F.slice("w", F.lit(2), F.size("w") - 1).alias("q"))).alias("part", "s"))
    return steps.select("eid", "part", F.col("s.p.px").alias("x1"), F.col("s.p.py").alias("y1"), F.col("s.q.px").alias("x2"), F.col("s.q.py").alias("y2"))


def self_intersections(polygons: DataFrame, key: str, size: float, rings: str = "rings") -> DataFrame:
    """(key, crossings): places where a polygon's edges cross or touch apart from the corners that neighbours share; valid ones have no row.

    Edge pairs come from bins. A ring that touches itself or another ring at a corner is listed too.
    Repeated rows count once; rows of one key that differ are judged apart, and added up.
    """
    from . import spatial

    once = polygons.select(F.col(key).alias("key"), F.xxhash64(rings).alias("h"), F.col(rings).alias("rings")).dropDuplicates(["key", "h"])
    e = rounded(spatial.edges_of(once, "key", "rings", "h"))
    # Edges are numbered along their ring, for those without length are gone; the last meets the first.
    own = Window.partitionBy("key", "h", "r")
    e = e.withColumns({"n": F.row_number().over(own.orderBy("i")), "last": F.count(F.lit(1)).over(own)})
    name = F.struct("key", "h", "r", "n", "last")
    e = e.select(name.alias("eid"), "x1", "y1", "x2", "y2")
    met = meetings(e, e.withColumnRenamed("eid", "fid"), size).where("eid.key <=> fid.key and eid.h = fid.h and eid < fid")
    gap = F.col("fid.n") - F.col("eid.n")
    beside = (F.col("eid.r") == F.col("fid.r")) & ((gap == 1) | (gap == F.col("eid.last") - 1))
    return met.where(~beside).select("eid.key", "eid.h", "px", "py").distinct().groupBy(F.col("key").alias(key)).agg(F.count(F.lit(1)).alias("crossings"))
