"""Rows at one place and equal shapes: the work is done once for them, and every row has its result."""

import math

import pytest
from pyspark.sql import functions as F

from parcelwise.operators import lines, models, parcels, planar, recipes, segments, spatial, subdivide
from parcelwise.sources import osm


def test_bandwidth_errors_of_all_rows(spark):
    rows = [(float(i % 8 + 1), float(i % 5), float(i % 3)) for i in range(2_500)]
    df = spark.createDataFrame(rows, "FFa double, FFb double, y double")
    got = models.bandwidth_error(df, ["FFa", "FFb"], "y", [0.05, 0.4])
    at = [(a / 8, b / 4, y) for a, b, y in rows]
    for s, error in got.items():
        whole = 0.0
        for a, b, y in set(at):
            w = [math.exp(-(abs(a - c) + abs(b - d)) / s) for c, d, _ in at]
            whole += at.count((a, b, y)) * abs((sum(u * t for u, (_, _, t) in zip(w, at, strict=True)) - y) / sum(w) - y)
        assert error == pytest.approx(whole / len(at), rel=1e-9)


def test_kernel_scores_meet_each_distinct_row_once(spark, monkeypatch):
    train = spark.createDataFrame([(float(i % 5 + 1), float(i % 3)) for i in range(600)], "FFa double, y double")
    rows = spark.createDataFrame([(i, float(i % 4)) for i in range(400)] + [(400, None)], "k long, FFa double")
    sizes = []
    packed = models._packed
    monkeypatch.setattr(models, "_packed", lambda df, columns, name: sizes.append(df.count()) or packed(df, columns, name))
    got = {r["k"]: r["score"] for r in models.apply_general(rows, train, ["FFa"], "y", 0.3, "k").collect()}
    assert sorted(sizes) == [4, 5]
    known = [((i % 5 + 1) / 5, i % 3) for i in range(600)]
    for k in range(4):
        w = [math.exp(-abs(k / 5 - a) / 0.3) for a, _ in known]
        want = sum(u * y for u, (_, y) in zip(w, known, strict=True)) / sum(w)
        assert all(got[i] == pytest.approx(want) for i in range(k, 400, 4))
    assert len(got) == 401 and got[400] is None


def test_copies_of_a_road_each_cut_it(spark):
    road = lambda *p: [{"x": float(a), "y": float(b)} for a, b in p]
    rows = [(0, road((0, 0), (60, 0)))] + [(k, road((20.5, -10), (20.5, 10))) for k in (1, 2, 3)] + [(4, road((40, -5), (40, 5)))]
    df = spark.createDataFrame(rows, "line long, pts array<struct<x double, y double>>")
    levels = df.select("line", F.lit(0).alias("level"))
    count = lambda every: {r["line"]: (r["n"], r["m"]) for r in lines.routable(lines.edges(df, "line"), levels, 7.0, every=every).groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("m")).collect()}
    assert count(True) == {0: (5, 60.0), 1: (2, 20.0), 2: (2, 20.0), 3: (2, 20.0), 4: (2, 10.0)}
    assert count(False)[0] == (3, 60.0)


def test_snapped_places_meet_an_edge_once(spark, monkeypatch):
    points = spark.createDataFrame([(k, float(k % 3), 1.0) for k in range(90)] + [(7, 50.0, 50.0)], "k long, px double, py double")
    e = spark.createDataFrame([(line, 0, 0.0, 0.0, 9.0, 0.0) for line in range(40, 0, -1)], "line long, seq int, x1 double, y1 double, x2 double, y2 double")
    sizes = []
    bins = lines._bins
    monkeypatch.setattr(lines, "_bins", lambda e, *a: sizes.append(e.count()) or bins(e, *a))
    got = lines.snapped(points, e, "k", 5.0).collect()
    assert sizes == [1]
    assert sorted((r["k"], r["line"], r["seq"], r["distance"]) for r in got) == [(k, 1, 0, 1.0) for k in range(90)]


@pytest.fixture
def counted(monkeypatch):
    """Numbers of rows that a function of a module is given, argument by argument."""

    def watch(module, name, args):
        sizes, real = [], getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: sizes.append(tuple(a[i].count() for i in args)) or real(*a, **k))
        return sizes

    return watch


def test_places_meet_once_within_range(spark, counted):
    left = spark.createDataFrame([(k, float(k % 3), 0.0) for k in range(60)], "k long, x double, y double")
    right = spark.createDataFrame([(k, float(k % 2), 1.0, float(k)) for k in range(40, 0, -1)], "o long, px double, py double, v double")
    sizes = counted(spatial, "within_range", (0, 1))
    near = {r["k"]: (r["o"], r["distance"]) for r in spatial.nearest(left, right, 5.0, "k", "o").collect()}
    assert near == {k: ((2, 1.0), (1, 1.0), (1, math.sqrt(2)))[k % 3] for k in range(60)}
    sums = {r["k"]: r for r in spatial.gaussian_sums(left, right, 1.0, "k", "v").collect()}
    for k in (0, 1, 2, 59):
        w = [(math.exp(-((k % 3 - i % 2) ** 2 + 1) / 2), i) for i in range(1, 41)]
        assert sums[k]["n"] == 40 and sums[k]["wsum"] == pytest.approx(sum(a * i for a, i in w)) and sums[k]["wmean"] == pytest.approx(sum(a * i for a, i in w) / sum(a for a, _ in w))
    buildings = right.select("px", "py", (F.col("v") % 4).alias("AREA"), (F.col("o") % 3).alias("WAG"))
    got = parcels.building_proximity(left.withColumnRenamed("k", "id"), buildings, 1.0).collect()
    assert len(got) == 60 and all((r["FFpbsize_sum"], r["FFpbsize_median"], r["FFpbwag_sum"], r["FFpbwag_median"]) == (60.0, 1.5, 40, 1.0) for r in got)
    poi = right.select("px", "py", F.lit("a").alias("subtype"))
    found = {r["id"]: r["FFppg"] for r in recipes.poi_proximity(left.withColumnRenamed("k", "id"), poi, {"g": ["a"]}, 1.0).collect()}
    assert len(found) == 60 and found[3] == pytest.approx(20 * math.exp(-0.5) + 20 * math.exp(-1))
    assert sizes == [(3, 2), (3, 2), (3, 4), (3, 6), (3, 2)]


def _boxes(spark, n, other="o"):
    box = lambda x: [[{"x": x + a, "y": b} for a, b in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0))]]
    return spark.createDataFrame([(k, box(10.0 * (k % 2))) for k in range(n, 0, -1)], f"{other} long, rings array<array<struct<x double, y double>>>")


def test_places_meet_a_shape_once(spark, counted):
    points = spark.createDataFrame([(k, 10.0 * (k % 3) + 1, 1.0) for k in range(30)], "k long, x double, y double")
    boxes, sizes = _boxes(spark, 20), counted(spatial, "edges_of", (0,))
    want = {(k, o) for k in range(30) for o in range(1, 21) if k % 3 == o % 2}
    for shapes in (boxes, boxes.union(boxes)):
        got = [tuple(r) for r in spatial.points_in_polygons(points.union(points), shapes, "k", "o", 3.0).collect()]
        assert len(got) == len(want) and set(got) == want
    twice = points.union(spark.createDataFrame([(0, 2.0, 2.0), (1, 2.0, 2.0)], points.schema))
    got = [tuple(r) for r in spatial.points_in_polygons(twice, boxes, "k", "o", 3.0).collect()]
    assert len(got) == len(want) + 10 and set(got) == want | {(1, o) for o in range(2, 21, 2)}
    near = {r["k"]: (r["o"], r["distance"]) for r in parcels.nearest_polygon(points, boxes, "k", "o", 8.0).collect()}
    assert near == {k: ((2, 0.0), (1, 0.0), (1, 7.0))[k % 3] for k in range(30)}
    flags = {r["k"]: r["builtup"] for r in parcels.built_up(points, boxes, "k", "o", 5.0).collect()}
    assert flags == {k: int(k % 3 < 2) for k in range(30)}
    assert set(sizes) == {(2,)}


def test_equal_shapes_are_divided_once(spark, monkeypatch):
    boxes = _boxes(spark, 24)
    sizes, real = [], type(boxes).mapInArrow
    monkeypatch.setattr(type(boxes), "mapInArrow", lambda df, *a, **k: sizes.append(df.count()) or real(df, *a, **k))
    got = subdivide.subdivide(boxes, "o", "rings", 9.0, 10.0).groupBy("o").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("a")).collect()
    assert sizes == [2] and sorted(tuple(r) for r in got) == [(o, 2, 16.0) for o in range(1, 25)]


def test_equal_polygons_are_cut_once_by_one_of_equal_barriers(spark, counted):
    boxes = _boxes(spark, 12, "id")
    line = [{"x": -1.0, "y": 1.0}, {"x": 5.0, "y": 1.0}]
    barriers = spark.createDataFrame([(k, line) for k in range(9)], "id long, pts array<struct<x double, y double>>")
    sizes = counted(planar, "meetings", (0, 1))
    got = segments.between_barriers(boxes, barriers, "id", 3.0).collect()
    assert sorted((r["id"], round(r["area"], 6)) for r in got) == sorted((k, a) for k in range(1, 13) for a in ((16.0,) if k % 2 else (4.0, 12.0)))
    assert sizes == [(8, 1), (1, 1)]


def _joins(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_computed_shapes_are_not_broadcast(spark):
    pt = lambda x, y: F.struct((F.col("id") + x).cast("double").alias("x"), F.lit(float(y)).alias("y"))
    lines_ = spark.range(50).select("id", F.array(*map(F.lit, (0, 1, 2, 0))).alias("refs"), F.array(*(pt(*p) for p in ((0, 0), (1, 0), (0, 1), (0, 0)))).alias("pts"))
    out = osm.relation_polygons(lines_.select("id", F.col("id").alias("wayref"), F.lit(True).alias("outer")), lines_)
    assert "Broadcast" not in _joins(out) and out.count() == 50
    e = spark.range(50).select(F.col("id").alias("eid"), *(F.lit(float(v)).alias(n) for n, v in (("x1", 0), ("y1", 0), ("x2", 4), ("y2", 4))))
    f = e.limit(1).select(F.col("eid").alias("fid"), "x1", F.lit(4.0).alias("y1"), "x2", F.lit(0.0).alias("y2"))
    met = planar.meetings(e, f, 3.0)
    cut = planar.pieces(e, met.select("eid", "px", "py"))
    assert "Broadcast" not in _joins(met) and "Broadcast" not in _joins(cut) and cut.count() == 100
