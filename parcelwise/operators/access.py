"""Transport access of places: roads to a network, test targets, costs, and the feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import ring_area
from . import lines, network, parcels, spatial, subdivide


def representative_targets(origins: DataFrame, n: int = 20) -> DataFrame:
    """(target, x, y): inner points of about ``n`` to 2n near-equal parts of the hull of the origins (x, y).

    The hull's vertices are few, so it is one row; no origin reaches the driver, only the
    hull's area. Origins on one line have no area and give their hull's vertices.
    """
    ring = network.kept(spatial.hull(origins).agg(F.sort_array(F.collect_list(F.struct("ord", "x", "y"))).alias("r")).select(F.lit(0).alias("id"), F.transform("r", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring")))
    area = ring.select(ring_area(F.col("ring"))).first()[0]
    if not area:
        return ring.select(F.posexplode("ring").alias("target", "p")).select("target", "p.x", "p.y")
    return subdivide.subdivide(ring, "id", "ring", area / n, float("inf")).select(F.col("part").alias("target"), "x", "y")


def vertex(x: Column, y: Column, digits: int = 3) -> Column:
    """A place's id: coordinates that agree to a millimetre are one vertex."""
    return F.concat_ws("|", F.round(x + 0.0, digits).cast("string"), F.round(y + 0.0, digits).cast("string"))


def road_network(roads: DataFrame, built: DataFrame, speeds: dict[int, dict[str, float]], side: float, near: float = 20.0) -> DataFrame:
    """Pieces (line, seq, part, x1..y2, length, builtup, class, oneway, speed, time) of roads (line, class, level, oneway, pts).

    Ground roads are cut where they cross, and pieces at the border of what lies within ``near``
    of built-up polygons (id, rings), so that each bit has the speed of its side. Bits of unknown speed go.
    """
    e = lines.edges(roads, "line")
    pieces = network.kept(lines.routable(e, roads.select("line", "level"), side).select(F.struct("line", "seq", "part").alias("piece"), "x1", "y1", "x2", "y2"))
    bits = parcels.split_built_up(pieces, built, "piece", "id", near)
    part = F.row_number().over(W.partitionBy("piece.line", "piece.seq").orderBy("piece.part", "bit")) - 1
    rows = bits.select("piece.line", "piece.seq", part.alias("part"), "x1", "y1", "x2", "y2", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("length"), "builtup")
    return network.timed(rows.join(roads.select("line", "class", "oneway"), "line"), speeds)


def access(origins: DataFrame, targets: DataFrame, pieces: DataFrame, tolerance: float = 200.0) -> DataFrame:
    """(id, FFacc) of origins (id, x, y): mean of all median costs to the targets (target, x, y) over the own one.

    Both are snapped to the nearest piece, and enter the network at that piece's nearer end.
    Origins beyond ``tolerance``, or that reach no target, have 0.
    """
    at = pieces.select(F.struct("line", "seq", "part").alias("line"), F.lit(0).alias("seq"), "x1", "y1", "x2", "y2")
    ends = at.select("line", *(vertex(F.col(f"x{i}"), F.col(f"y{i}")).alias(f"v{i}") for i in (1, 2)))

    def entered(places: DataFrame, key: str) -> DataFrame:
        spots = lines.snapped(places.select(key, F.col("x").alias("px"), F.col("y").alias("py")), at, key, tolerance)
        return spots.join(ends, "line").select(key, F.when(F.col("t") <= 0.5, F.col("v1")).otherwise(F.col("v2")).alias("v"))

    edges = pieces.select(vertex(F.col("x1"), F.col("y1")).alias("src"), vertex(F.col("x2"), F.col("y2")).alias("dst"), F.col("time").alias("cost"), "oneway")
    start, goal = network.kept(entered(origins, "id")), entered(targets, "target").select(F.col("v").alias("target")).distinct()
    rated = network.accessibility(network.cost_matrix(network.directed(edges, F.col("oneway")), goal), start.select("v"))
    out = origins.select("id").distinct().join(start.join(rated, "v").select("id", F.col("access").alias("FFacc")), "id", "left")
    return out.select("id", F.coalesce("FFacc", F.lit(0.0)).alias("FFacc"))
