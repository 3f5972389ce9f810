"""Land use cut by barriers: the parcels that everything else works on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import polygon_area
from ..functions.selectors import any_prefix
from . import planar, spatial, subdivide
from .network import kept

RINGS = "array<array<struct<x double, y double>>>"


def between_barriers(polygons: DataFrame, barriers: DataFrame, key: str, side: float) -> DataFrame:
    """(key, part, area, rings): polygons (key, rings) cut by barriers (id, pts); rings are the outer one and holes.

    Edges, not lines, are cut where they cross, touch or overlap, by joins on square bins. Pieces
    of barriers go to the polygon that their middle lies in, and the faces of a polygon's edges and
    pieces are its parts: a task holds one polygon at a time. Barriers may meet each other,
    run along borders or through corners; ends that lead nowhere cut nothing, closed barriers cut
    islands. Polygons that no barrier meets stay as they are. Null or empty rings give none, rows
    with a null key neither; repeated rows count once, polygons of one key are one. Equal polygons
    are cut once, by one of barriers that run over each other, and their parts go to every key.
    """
    given = polygons.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.filter("rings", lambda r: F.size(r) > 2).alias("rings")).where(F.size("rings") > 0)
    shapes = given.select("key", spatial.shape_id("rings").alias("s"), "rings").dropDuplicates(["key", "s"])
    named = kept(shapes.groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("s")).withColumn("s", spatial.shape_id("s")))
    least = kept(named.groupBy("s").agg(F.min("key").alias("key")))
    whole = kept(shapes.drop("s").join(least.select("key").hint("merge"), "key", "left_semi"))
    border = planar.rounded(spatial.edges_of(whole.withColumn("rh", F.xxhash64("rings")), "key", "rings", "rh")).select(F.struct("key", "rh", "r", "i").alias("eid"), "x1", "y1", "x2", "y2")
    steps = barriers.where(F.size("pts") > 1).select(F.posexplode(F.arrays_zip(F.slice("pts", F.lit(1), F.size("pts") - 1).alias("p"), F.slice("pts", F.lit(2), F.size("pts") - 1).alias("q"))).alias("i", "e"), F.struct(F.col("id").alias("id"), F.xxhash64("pts").alias("h")).alias("line"))
    walls = planar.rounded(steps.select(F.struct("line", "i").alias("fid"), F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2")))
    walls = kept(walls.groupBy("x1", "y1", "x2", "y2").agg(F.min("fid").alias("fid")))
    met = kept(planar.meetings(border, walls, side))
    among = planar.meetings(walls.withColumnRenamed("fid", "eid"), walls, side).where("eid != fid").select("eid", "px", "py")
    cuts = met.select(F.col("fid").alias("eid"), "px", "py").unionByName(among)
    parts = kept(planar.pieces(walls.withColumnRenamed("fid", "eid"), cuts).withColumn("piece", F.struct("eid", "part")))
    middles = parts.select("piece", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    within = spatial.points_in_polygons(middles, whole, "piece", "key", side)
    inner = kept(parts.hint("merge").join(within.hint("merge"), "piece").select("key", "x1", "y1", "x2", "y2"))
    touched = inner.select("key").distinct().hint("merge")
    own = border.join(touched, F.col("eid.key") == F.col("key"), "left_semi")
    outline = planar.pieces(own, met.select("eid", "px", "py").join(touched, F.col("eid.key") == F.col("key"), "left_semi")).select(F.col("eid.key").alias("key"), "x1", "y1", "x2", "y2")
    edges = outline.withColumn("border", F.lit(True)).unionByName(inner.withColumn("border", F.lit(False)))
    kind = polygons.schema[key].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            keys, rows, shapes = [], [], []
            groups = batch.column(1)
            ends, flat = groups.offsets.to_numpy(), groups.values
            corners = np.stack([flat.field(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], 1)
            border = flat.field("border").to_numpy(zero_copy_only=False).astype(bool)
            for k, (low, high) in enumerate(zip(ends, ends[1:], strict=False)):
                e = corners[low:high]
                # Equal rows of a table repeat all their edges; one of each is the outline.
                ring = np.unique(e[border[low:high]], axis=0)
                found = planar.faces(e)
                spots = np.array([planar.inner_point(p) for p in found]).reshape(-1, 2)
                own = sorted((p for p, yes in zip(found, planar.inside(spots, ring), strict=True) if yes), key=lambda p: p[0].min(0).tolist())
                keys += [k] * len(own)
                rows += [(i, planar.area_of(p)) for i, p in enumerate(own)]
                shapes += [planar.points_in(p) for p in own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int32())), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array(shapes, planar.SHAPE)], ["key", "part", "area", "rings"])

    groups = edges.groupBy("key").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2", "border")).alias("edges"))
    split = groups.mapInArrow(cut, f"key {kind}, part int, area double, rings {RINGS}")
    # A key of several polygons that no barrier meets keeps one of them, the least by its name.
    left = whole.join(touched, "key", "left_anti").groupBy("key").agg(F.min_by("rings", F.xxhash64("rings")).alias("rings"))
    rest = left.select("key", F.lit(0).alias("part"), polygon_area(F.array("rings")).alias("area"), F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))).alias("rings"))
    found = split.unionByName(rest).join(least.hint("merge"), "key").drop("key")
    return named.withColumnRenamed("key", "__key").hint("merge").join(found, "s").select(F.col("__key").alias(key), "part", "area", "rings")


def create_segments(land_use: DataFrame, barriers: DataFrame, side: float, inhabited: list[str], least_area: float, key: str = "id", code: str = "code", most_area: float | None = None, most_wagner: float | None = None) -> DataFrame:
    """(id, part, code, area, rings): inhabited land use (id, code, rings) cut by barriers, parts over ``least_area``.

    A part keeps the code of the polygon that it was cut from. inhabited: prefixes of codes; an
    empty list keeps nothing. With ``most_area`` parts are subdivided below it, and below
    ``most_wagner`` where that is given, before small ones go.
    """
    lived_in = land_use.where(any_prefix(F.col(code), inhabited)) if inhabited else land_use.limit(0)
    parts = between_barriers(lived_in, barriers, key, side)
    if most_area is not None:
        one = parts.withColumn("whole", F.struct(key, "part"))
        small = subdivide.subdivide(one, "whole", "rings", most_area, float("inf") if most_wagner is None else most_wagner)
        rank = F.row_number().over(W.partitionBy(key).orderBy("cut", "part")) - 1
        parts = small.select(F.col(f"whole.{key}").alias(key), F.col("whole.part").alias("cut"), "part", "area", "rings").select(key, rank.alias("part"), "area", "rings")
    codes = lived_in.groupBy(key).agg(F.min(code).alias(code))
    return parts.where(F.col("area") > least_area).join(codes.hint("merge"), key).select(key, "part", code, "area", "rings")
