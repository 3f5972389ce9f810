"""Cutting by barriers, targets and access, against hand-made cases and plain Python."""

import heapq
import math
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from parcelwise.operators import access, segments

SQUARE = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)


def pts(df, *places):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in places))


def test_create_segments_keeps_codes_and_sizes(spark):
    use = spark.range(3).select("id", F.element_at(F.array(F.lit("11"), F.lit("2"), F.lit("12")), (F.col("id") + 1).cast("int")).alias("code"), F.array(F.transform(pts(None, *SQUARE.tolist(), (0, 0)), lambda p: F.struct((p["x"] + 20 * F.col("id")).alias("x"), p["y"].alias("y")))).alias("rings"))
    use = use.unionByName(spark.createDataFrame([(9, "11", None)], "id bigint, code string, rings array<array<struct<x double, y double>>>"))
    barriers = spark.range(1).select("id", pts(None, (-1, 1), (60, 1)).alias("pts"))
    found = segments.create_segments(use, barriers, 7.0, ["1"], 15.0).collect()
    assert sorted((r["id"], r["code"], r["area"]) for r in found) == [(0, "11", 90.0), (2, "12", 90.0)]
    none = segments.create_segments(use, barriers.limit(0), 7.0, ["1"], 15.0).collect()
    assert sorted((r["id"], r["area"]) for r in none) == [(0, 100.0), (2, 100.0)]


def test_targets_lie_in_the_hull(spark):
    origins = spark.range(400).select((F.col("id") % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"))
    found = access.representative_targets(origins, 20).collect()
    assert 20 <= len(found) <= 40 and len({(t["x"], t["y"]) for t in found}) == len(found)
    assert all(0 < t["x"] < 19 and 0 < t["y"] < 19 for t in found)


def test_access_matches_dijkstra(spark):
    """A grid of streets; costs by plain Python from the places where origins and targets enter."""
    n, step = 4, 100
    roads = [(i, "street", 0, None, [(-5, i * step), (n * step - step + 5, i * step)]) for i in range(n)] + [(10 + i, "lane", 0, None, [(i * step, -5), (i * step, n * step - step + 5)]) for i in range(n)]
    schema = "line bigint, class string, level int, oneway boolean, pts array<struct<x double, y double>>"
    table = spark.createDataFrame([(a, b, c, d, [(float(x), float(y)) for x, y in p]) for a, b, c, d, p in roads], schema)
    built = spark.createDataFrame([(1, [[(-50.0, -50.0), (120.0, -50.0), (120.0, 120.0), (-50.0, 120.0), (-50.0, -50.0)]])], "id bigint, rings array<array<struct<x double, y double>>>")
    pieces = access.road_network(table, built, {0: {"street": 50, "lane": 30}, 1: {"street": 30, "lane": 10}}, 80.0)
    assert pieces.count() == 2 * n * (n + 1) + 4, "between crossings, and four at the border of what is built up"
    graph = {}
    for p in pieces.collect():
        a, b = (round(p["x1"]), round(p["y1"])), (round(p["x2"]), round(p["y2"]))
        graph.setdefault(a, []).append((b, p["time"]))
        graph.setdefault(b, []).append((a, p["time"]))

    def costs(start):
        best, todo = {}, [(0.0, start)]
        while todo:
            c, v = heapq.heappop(todo)
            if v not in best:
                best[v] = c
                for w, d in graph[v]:
                    heapq.heappush(todo, (c + d, w))
        return best

    origins = spark.createDataFrame([(1, 20.0, 7.0), (2, 210.0, 120.0), (3, 290.0, 296.0), (4, 5000.0, 0.0)], "id bigint, x double, y double")
    targets = spark.createDataFrame([(1, 110.0, 203.0), (2, 298.0, 30.0), (3, 4.0, 290.0)], "target bigint, x double, y double")
    at = {1: (0, 0), 2: (200, 100), 3: (300, 300)}
    to = [costs(g) for g in ((100, 200), (300, 0), (0, 300))]
    own = {k: median(c[v] for c in to) for k, v in at.items()}
    mean = sum(own.values()) / len(own)
    found = {r["id"]: r["FFacc"] for r in access.access(origins, targets, pieces).collect()}
    assert found.pop(4) == 0
    assert all(math.isclose(found[k], mean / own[k], rel_tol=1e-9) for k in at)
