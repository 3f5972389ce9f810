"""OpenStreetMap XML: six normalised tables, and their assembly to features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import planar

#: Tags that are dropped on reading, and the relation types that make areas.
DROPPED_TAGS = ["source", "fixme", "created_by"]
AREA_RELATIONS = ["boundary", "multipolygon"]

_TAGS = "tag array<struct<_k string, _v string>>"
_SCHEMAS = {
    "node": f"_id bigint, _lat double, _lon double, {_TAGS}",
    "way": f"_id bigint, nd array<struct<_ref bigint>>, {_TAGS}",
    "relation": f"_id bigint, member array<struct<_type string, _ref bigint, _role string>>, {_TAGS}",
}


def tag_map(tags: Column) -> Column:
    """Map of the tags; a repeated key keeps its last value; dropped ones go; empty maps are null."""
    named = F.filter(F.coalesce(tags, F.array().cast("array<struct<_k string, _v string>>")), lambda t: ~t["_k"].isin(DROPPED_TAGS))
    keys = F.array_distinct(F.transform(named, lambda t: t["_k"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(named, lambda t: t["_k"] == k), -1)["_v"])
    return F.when(F.size(keys) > 0, F.map_from_arrays(keys, last))


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodegeoms, nodes, wayrefs, ways, relrefs, rels; overlapping downloads give each element once."""
    raw = {k: spark.read.format("xml").option("rowTag", k).schema(s).load(path) for k, s in _SCHEMAS.items()}
    node = raw["node"].dropDuplicates(["_id"])
    way = raw["way"].dropDuplicates(["_id"])
    rel = raw["relation"].dropDuplicates(["_id"])
    tagged = lambda df: df.select(F.col("_id").alias("id"), tag_map(F.col("tag")).alias("tags")).where("tags is not null")
    members = rel.select(F.col("_id").alias("id"), F.explode("member").alias("m")).where("m._type = 'way'")
    return {
        "nodegeoms": node.select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon")),
        "nodes": tagged(node),
        "wayrefs": way.select(F.col("_id").alias("id"), F.posexplode("nd").alias("ord", "n")).select("id", F.col("n._ref").alias("noderef"), (F.col("ord") + 1).alias("ord")),
        "ways": tagged(way),
        "relrefs": members.select("id", F.col("m._ref").alias("wayref"), (F.coalesce(F.col("m._role"), F.lit("")) != "inner").alias("outer")),
        "rels": tagged(rel).where(F.col("tags")["type"].isin(AREA_RELATIONS)),
    }


def points(nodes: DataFrame, nodegeoms: DataFrame) -> DataFrame:
    return nodes.join(nodegeoms, "id").select("id", "tags", F.col("lon").alias("x"), F.col("lat").alias("y"))


def way_lines(wayrefs: DataFrame, nodegeoms: DataFrame) -> DataFrame:
    """(id, refs, pts): node ids and coordinates in order. A way's nodes are bounded, a node's ways aren't joined here twice."""
    at = nodegeoms.select(F.col("id").alias("noderef"), "lon", "lat")
    rows = wayrefs.dropDuplicates(["id", "ord"]).join(at, "noderef")
    return rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ord", "noderef", "lon", "lat"))).alias("p")).select("id", F.transform("p", lambda p: p["noderef"]).alias("refs"), F.transform("p", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("pts"))


def is_line(tags: Column) -> Column:
    """Does a closed way with these tags stay a line?"""
    area = tags["area"]
    return F.when(area.isNotNull(), (area == "no") | F.coalesce(tags["highway"] == "pedestrian", F.lit(False))).otherwise(tags["highway"].isNotNull() | tags["barrier"].isNotNull())


def way_features(lines: DataFrame, ways: DataFrame) -> DataFrame:
    """(id, tags, kind, pts): closed ways that aren't lines are polygons of more than three vertices, or go."""
    rows = lines.join(ways, "id")
    closed = (F.element_at("refs", 1) == F.element_at("refs", -1)) & ~is_line(F.col("tags"))
    kind = F.when(closed, F.when(F.size("refs") > 3, "Polygon")).otherwise("LineString")
    return rows.withColumn("kind", kind).where("kind is not null").select("id", "tags", "kind", "pts")


def common_tags(relrefs: DataFrame, ways: DataFrame) -> DataFrame:
    """(id, k, v): tags that all tagged member ways of a relation share."""
    member = relrefs.select("id", "wayref").distinct().join(ways.select(F.col("id").alias("wayref"), "tags"), "wayref")
    tagged = member.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    each = member.select("id", F.explode("tags").alias("k", "v")).groupBy("id", "k", "v").agg(F.count(F.lit(1)).alias("c"))
    return each.join(tagged, "id").where("c = n").select("id", "k", "v")


def relation_tags(rels: DataFrame, common: DataFrame) -> DataFrame:
    """(id, tags): own tags and those common to the ways, which win; without ``type``; none left, no row."""
    shared = common.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("shared"))
    rows = rels.join(shared, "id", "left").withColumn("shared", F.coalesce("shared", F.create_map().cast("map<string,string>")))
    own = F.map_filter("tags", lambda k, v: (k != "type") & ~F.map_contains_key("shared", k))
    return rows.select("id", F.map_concat(own, F.map_filter("shared", lambda k, v: k != "type")).alias("tags")).where(F.size("tags") > 0)


def stitch(ways: list[tuple[list[int], list]]) -> list[tuple[list[int], list]] | None:
    """Rings of (refs, points) from ways that meet end to end; None if one stays open.

    A walk takes the least unused way at the place where it stands, in either direction, and
    turns into a ring whenever it comes back to a place on it. Only numbers of ways are kept until
    a ring is whole, so the work is in proportion to the ways. Rings stand in the order of their least ways.
    """
    rings = [(k, list(refs), list(pts)) for k, (refs, pts) in enumerate(ways) if refs[0] == refs[-1]]
    names = [k for k, (refs, _) in enumerate(ways) if refs[0] != refs[-1]]
    open_ = [ways[k] for k in names]
    at: dict[int, list[int]] = {}
    for k in reversed(range(len(open_))):
        for end in (open_[k][0][0], open_[k][0][-1]):
            at.setdefault(end, []).append(k)  # the least way is last
    used = [False] * len(open_)
    for first in range(len(open_)):
        if used[first]:
            continue
        here = open_[first][0][0]
        walk, nodes, place = [], [here], {here: 0}
        while True:
            todo = at[here]
            while todo and used[todo[-1]]:
                todo.pop()
            if not todo:
                break
            k = todo.pop()
            used[k] = True
            forward = open_[k][0][0] == here
            walk.append((k, forward))
            here = open_[k][0][-1 if forward else 0]
            if here in place:
                start = place[here]
                refs, pts = [here], []
                for way, ahead in walk[start:]:
                    r, p = open_[way] if ahead else (open_[way][0][::-1], open_[way][1][::-1])
                    refs += r[1:]
                    pts += p[0 if not pts else 1 :]
                rings.append((min(names[way] for way, _ in walk[start:]), refs, pts))
                for node in nodes[start + 1 :]:
                    del place[node]
                del walk[start:], nodes[start + 1 :]
                if not walk:
                    break
            else:
                place[here] = len(nodes)
                nodes.append(here)
        if walk:
            return None
    return [(refs, pts) for _, refs, pts in sorted(rings, key=lambda x: x[0]) if len(refs) > 3]


#: Relations that are Python objects at once in a task.
SLICE = 256


def relation_polygons(relrefs: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, parts): stitched outer rings with their holes; relations that don't close have no row.

    One relation is one group, bounded by its own members; ``lines`` are the ways that
    ``way_lines`` has put together, so coordinates are joined once.
    """
    ways = lines.select(F.col("id").alias("wayref"), "refs", F.transform("pts", lambda p: F.array(p["x"], p["y"])).alias("pts"))
    # Spark takes tables of computed shapes for smaller than they are, and would broadcast them.
    member = relrefs.distinct().join(ways.hint("merge"), "wayref").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("wayref", "outer", "refs", "pts"))).alias("ways"))
    kind = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))

    def turned(ring: list, ccw: bool) -> list:
        return ring if (planar.ring_area(np.array(ring)) > 0) == ccw else ring[::-1]

    def build(ways: list[dict]) -> list | None:
        outer, inner = (stitch([(w["refs"], w["pts"]) for w in ways if w["outer"] == flag]) for flag in (True, False))
        if not outer or inner is None:
            return None
        parts = [[turned(p, True)] for _, p in outer]
        edges = [planar.edges_of([np.array(q[0])]) for q in parts] if len(parts) > 1 and inner else []
        for _, hole in inner:
            home = parts[0] if len(parts) == 1 else next((q for q, e in zip(parts, edges, strict=True) if planar.inside(np.array(hole[:1]), e)[0]), None)
            if home is not None:
                home.append(turned(hole, False))
        return parts

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                built = [build(ways) for ways in some.column(1).to_pylist()]
                at = pa.array([i for i, p in enumerate(built) if p is not None], pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), pa.array([p for p in built if p is not None], kind)], ["id", "parts"])

    return member.mapInArrow(run, "id bigint, parts array<array<array<array<double>>>>")
