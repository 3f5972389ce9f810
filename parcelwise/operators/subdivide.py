"""Subdivision of polygons, and points that stand for them (numpy inside map tasks, one polygon a row)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import planar, spatial
from .planar import after, before, ring_area

#: Corners and places on edges that a dividing line may join.
CORNERS, PLACES = 96, 32
#: Least share of a half, tried from the first on.
SHARES = (0.25, 0.1, 0.02, 0.0)


def halves(ring: np.ndarray) -> list[np.ndarray]:
    """A convex ring cut across the middle of the longer side of its box, by clipping both half-planes."""
    lo, hi = ring.min(0), ring.max(0)
    axis = int(hi[1] - lo[1] > hi[0] - lo[0])
    at = (lo[axis] + hi[axis]) / 2
    out = []
    for sign in (1, -1):
        d = sign * (ring[:, axis] - at)
        kept = []
        for i in range(len(ring)):
            j = (i + 1) % len(ring)
            if d[i] >= 0:
                kept.append(ring[i])
            if d[i] * d[j] < 0:
                kept.append(ring[i] + (ring[j] - ring[i]) * d[i] / (d[i] - d[j]))
        if len(kept) > 2:
            out.append(np.array(kept))
    return out


def wagner(ring: np.ndarray) -> float:
    area = abs(ring_area(ring))
    length = np.hypot(*(after(ring) - ring).T).sum()
    return length / (2 * math.sqrt(math.pi * area)) if area > 1e-6 else 0.0


def _turns(ring: np.ndarray) -> np.ndarray:
    """Positive at corners that turn left."""
    a, b = ring - before(ring), after(ring) - ring
    return a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]


def simplified(ring: np.ndarray, shortest: float = 0.0) -> np.ndarray:
    """The ring without corners on a straight line and edges up to ``shortest``; three corners stay at least."""
    while len(ring) > 3:
        step = np.hypot(*(after(ring) - ring).T)
        gone = (np.abs(_turns(ring)) <= 1e-9 * np.maximum(step * before(step), 1e-12)) | (step <= shortest)
        if not gone.any():
            break
        # Not two neighbours at once: the second may matter once the first has gone.
        first = gone & ~before(gone)
        keep = ~(first if first.any() else gone & (np.arange(len(gone)) % 2 == 0))
        if keep.sum() < 3:
            break
        ring = ring[keep]
    return ring


def _clear(ring: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """The open line from a to b meets no edge of the ring."""
    c, d = ring, after(ring)
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    a1, a2, b1, b2 = cross(d - c, a - c), cross(d - c, b - c), cross(b - a, c - a), cross(b - a, d - a)
    if ((a1 * a2 < 0) & (b1 * b2 < 0)).any():
        return False
    t = ((c - a) * (b - a)).sum(1) / max(((b - a) ** 2).sum(), 1e-300)
    return not ((np.abs(b1) <= 1e-9 * max(((b - a) ** 2).sum(), 1e-300)) & (t > 1e-9) & (t < 1 - 1e-9)).any()


def _in_cone(ring: np.ndarray, i: int, q: np.ndarray) -> bool:
    """The way from corner i to q starts inside a counter-clockwise ring."""
    p, last, following = ring[i], ring[i - 1], ring[(i + 1) % len(ring)]
    left = lambda u, v, w: (v[0] - u[0]) * (w[1] - u[1]) - (v[1] - u[1]) * (w[0] - u[0])
    if left(last, p, following) > 0:
        return left(p, q, last) > 0 and left(p, following, q) > 0
    return not (left(p, q, following) >= 0 and left(p, last, q) >= 0)


def bridged(rings: list[np.ndarray]) -> np.ndarray:
    """One ring of a polygon with holes: each hole is joined to the nearest corner of the ring that is in sight."""
    ring = rings[0] if ring_area(rings[0]) > 0 else rings[0][::-1]
    holes = [h[::-1] if ring_area(h) > 0 else h for h in rings[1:]]
    while holes:
        gaps = [np.hypot(*(ring[:, None] - h[None]).transpose(2, 0, 1)) for h in holes]
        k = min(range(len(holes)), key=lambda i: gaps[i].min())
        hole, gap = holes[k], gaps[k]
        others = [h for i, h in enumerate(holes) if i != k]
        best = None
        for at in np.argsort(gap, axis=None):
            i, j = divmod(int(at), len(hole))
            a, b = ring[i], hole[j]
            if _in_cone(ring, i, b) and all(_clear(r, a, b) for r in (ring, hole, *others)):
                best = (i, j)
                break
        i, j = best or divmod(int(gap.argmin()), len(hole))
        ring = np.concatenate([ring[: i + 1], np.roll(hole, -j, 0), hole[j : j + 1], ring[i:]])
        holes.pop(k)
    return ring


def parted(ring: np.ndarray) -> list[np.ndarray] | None:
    """A counter-clockwise ring in two along a short inner line with near-equal halves; None if no line is found.

    Corners that turn right come first as ends, then other corners and places on long edges.
    """
    step = np.hypot(*(after(ring) - ring).T)
    total = step.sum()
    n = 2 * np.ceil(step * PLACES / (2 * total)).astype(int)
    n[step < total / PLACES] = 1
    owner = np.repeat(np.arange(len(ring)), n)
    share = np.concatenate([np.arange(k) / k for k in n])
    pts = ring[owner] + share[:, None] * (after(ring) - ring)[owner]
    corner = share == 0
    turn = _turns(pts)
    rank = np.where(corner & (turn < 0), 0, np.where(corner, 1, 2))
    if len(pts) > CORNERS + PLACES:
        size = np.abs(turn)
        order = np.lexsort((-size, rank))
        chosen = np.sort(order[: CORNERS + PLACES])
    else:
        chosen = np.arange(len(pts))
    x, y = (pts - pts[0]).T
    run = np.concatenate([[0.0], np.cumsum(x * after(y) - after(x) * y)]) / 2
    whole = run[-1]
    i, j = (chosen[k] for k in np.triu_indices(len(chosen), 1))
    cut = run[j] - run[i] + (x[j] * y[i] - x[i] * y[j]) / 2
    part = np.minimum(cut, whole - cut) / whole
    length = np.hypot(*(pts[j] - pts[i]).T)
    ok = (part > 1e-9) & (length > 0)
    cost = np.where(ok, length / np.where(ok, part, 1.0) * (1 + 0.1 * (rank[i] + rank[j])), np.inf)
    for least in SHARES:
        fit = np.flatnonzero(ok & (part > least))
        for k in fit[np.argsort(cost[fit], kind="stable")]:
            a, b = int(i[k]), int(j[k])
            if _in_cone(pts, a, pts[b]) and _in_cone(pts, b, pts[a]) and _clear(ring, pts[a], pts[b]):
                return [pts[a : b + 1], np.concatenate([pts[b:], pts[: a + 1]])]
    return None


def parts_of(ring: np.ndarray, most_area: float, most_wagner: float, least_area: float) -> list[np.ndarray]:
    """Rings that cover ``ring``: under ``most_area`` and, from ``least_area`` on, under ``most_wagner`` if cuts bring it down."""
    todo, done = [simplified(ring if ring_area(ring) > 0 else ring[::-1])], []
    while todo:
        r = todo.pop()
        area, w = abs(ring_area(r)), None
        if area <= 0:
            continue
        if area < most_area:
            w = wagner(r)
            if area < least_area or w < most_wagner:
                done.append(r)
                continue
        flat = (_turns(r) >= 0).all()
        two = [t if flat else simplified(t) for t in (halves(r) if flat else parted(r)) or [] if abs(ring_area(t)) > 0]
        if len(two) < 2 or w is not None and max(map(wagner, two)) >= w:
            done.append(r)
        else:
            todo += two
    return done


def interior(ring: np.ndarray) -> tuple[float, float]:
    """The centroid if it lies inside, else the middle of the widest span on a scan line."""
    return interior_of([ring])


def interior_of(polygon: list[np.ndarray]) -> tuple[float, float]:
    """``interior`` of a polygon with holes."""
    edges = planar.edges_of(polygon)
    x, y = (polygon[0] - polygon[0][0]).T
    c = x * after(y) - after(x) * y
    area = c.sum() / 2
    if area:
        centre = polygon[0][0] + np.array([((x + after(x)) * c).sum(), ((y + after(y)) * c).sum()]) / (6 * area)
        if planar.inside(centre[None], edges)[0]:
            return float(centre[0]), float(centre[1])
    return planar.inner_point(polygon)


def unbridged(ring: np.ndarray) -> list[list[np.ndarray]]:
    """The polygons, with holes, that a ring with joints covers: edges with it on both sides go."""
    edges = planar.edges_of([ring])
    found = planar.faces(planar.cut_edges(edges))
    spots = np.array([planar.inner_point(p) for p in found]).reshape(-1, 2)
    return [p for p, yes in zip(found, planar.inside(spots, edges), strict=True) if yes]


def subdivide(polygons: DataFrame, key: str, rings: str, most_area: float, most_wagner: float, least_area: float | None = None) -> DataFrame:
    """(key, part, x, y, area, rings): parts that cover each polygon, with an interior point each.

    Parts are under ``most_area`` and, from ``least_area`` (a fifth of that) on, under
    ``most_wagner`` unless a cut would not bring it down. ``rings`` names a column of rings (the outer
    one, then holes) or of one ring. Convex parts are halved across, others along short
    inner lines; holes are joined to the outer ring first, and what remains of the joints is taken out
    of the parts again. Areas add up to the source's. Null, empty and flat polygons have no parts;
    rows are judged one by one, but equal shapes are divided once and their parts spread to the rows.
    """
    least = most_area / 5 if least_area is None else least_area
    single = "array<array<" not in polygons.schema[rings].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, shapes = [], []
            for k, given in enumerate(planar.polygons_of(batch.column(1))):
                shape = [r for r in given if ring_area(r)]
                if not shape:
                    continue
                found = [p for part in parts_of(bridged(shape), most_area, most_wagner, least) for p in (unbridged(part) if len(shape) > 1 else [[part]])]
                rows += [(k, n, *interior_of(p), planar.area_of(p)) for n, p in enumerate(found)]
                shapes += [planar.points_in(p) for p in found]
            own = [pa.array([r[c] for r in rows], kind_) for c, kind_ in enumerate((pa.int32(), pa.int32(), *[pa.float64()] * 3))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own[0]), *own[1:], pa.array(shapes, planar.SHAPE)], ["s", "part", "x", "y", "area", "rings"])

    shape = F.array(rings) if single else F.col(rings)
    rows = polygons.where(F.col(rings).isNotNull()).select(F.col(key).alias("k"), spatial.shape_id(shape).alias("s"), shape.alias("r"))
    # So many tasks as Spark shuffles to: small rows are long work, which mustn't be drawn together by their size.
    tasks = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = rows.select("s", "r").repartition(tasks, "s").dropDuplicates(["s"]).select("s", "r")
    found = once.mapInArrow(run, "s struct<a: bigint, b: bigint>, part int, x double, y double, area double, rings array<array<struct<x double, y double>>>")
    return rows.select(F.col("k").alias(key), "s").join(found, "s").drop("s")
