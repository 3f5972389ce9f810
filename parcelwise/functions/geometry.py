"""Measures of rings and polygons as Columns.

A ring is ``array<struct<x double, y double>>`` whose last point may repeat the first; a
polygon is an array of rings, the outer one first; parts are an array of polygons.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(ring: Column, term) -> Column:
    """Sum of term(p, q) over the closed ring's edges."""
    n = F.size(ring)
    steps = F.sequence(F.lit(1), n)
    return F.aggregate(steps, F.lit(0.0), lambda a, i: a + term(F.element_at(ring, i), F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))))


def signed_area(ring: Column) -> Column:
    return _edges(ring, lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]) / 2)


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_perimeter(ring: Column) -> Column:
    return _edges(ring, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))


def polygon_area(parts: Column) -> Column:
    """Outer rings less holes, summed over parts."""
    one = lambda part: F.aggregate(F.transform(part, lambda r, i: F.when(i == 0, ring_area(r)).otherwise(-ring_area(r))), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(F.transform(parts, one), F.lit(0.0), lambda a, b: a + b)


def polygon_perimeter(parts: Column) -> Column:
    """Holes count too."""
    return F.aggregate(F.transform(F.flatten(parts), ring_perimeter), F.lit(0.0), lambda a, b: a + b)


def wagner(perimeter: Column, area: Column) -> Column:
    """Perimeter over that of a circle of the same area; 0 for areas up to 1e-6."""
    return F.when(area > 1e-6, perimeter / (2 * F.sqrt(F.lit(math.pi) * area))).otherwise(0.0)


def clockwise(ring: Column) -> Column:
    return _edges(ring, lambda p, q: (q["x"] - p["x"]) * (q["y"] + p["y"])) > 0


def wound(ring: Column, want_clockwise: bool) -> Column:
    return F.when(clockwise(ring) == F.lit(want_clockwise), ring).otherwise(F.reverse(ring))


def bounds(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def crosses(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Does the ray to the right of the point cross the edge? Lower ends are out, upper ends in."""
    at = (py - y1) * (x2 - x1) / F.when(y1 == y2, 1.0).otherwise(y2 - y1) + x1
    return (py > F.least(y1, y2)) & (py <= F.greatest(y1, y2)) & (px <= F.greatest(x1, x2)) & ((x1 == x2) | (px <= at))


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    hits = _edges(ring, lambda p, q: F.when(crosses(px, py, p["x"], p["y"], q["x"], q["y"]), 1.0).otherwise(0.0))
    return hits % 2 == 1


def side(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Positive left of the line from a to b."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segments_cross(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column], d: tuple[Column, Column]) -> Column:
    """Do the open segments ab and cd cross?"""
    return (side(*c, *a, *b) * side(*d, *a, *b) < 0) & (side(*a, *c, *d) * side(*b, *c, *d) < 0)


def line_point(points: Column) -> Column:
    """Middle vertex."""
    return F.element_at(points, F.floor(F.size(points) / 2).cast("int") + 1)


def densified(ax: Column, ay: Column, bx: Column, by: Column, longest: float) -> Column:
    """Points from a to b, no farther apart than ``longest``, both ends in."""
    n = F.greatest(F.ceil(F.hypot(bx - ax, by - ay) / longest), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((ax + (bx - ax) * i / n).alias("x"), (ay + (by - ay) * i / n).alias("y")))


def transverse_mercator(lon: Column, lat: Column, lon0: float, k0: float = 0.9996, east: float = 500_000.0, north: float = 0.0) -> tuple[Column, Column]:
    """WGS-84 degrees to metres, by the published Krueger series to the third order."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    dl = F.radians(lon - lon0)
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return east + k0 * radius * x, north + k0 * radius * y
