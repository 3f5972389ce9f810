"""Faces, cuts, clips and subdivision against areas that must hold, on hand-made and random shapes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.functions.geometry import polygon_area
from parcelwise.operators import parcels, planar, segments, spatial, subdivide

SQUARE = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
RINGS = "array<array<struct<x double, y double>>>"


def rings(*shapes):
    return [[(float(x), float(y)) for x, y in r] for r in shapes]


def areas(paths, ring=SQUARE):
    e = np.concatenate([planar.edges_of([ring]), *(np.concatenate([np.array(p[:-1], float), np.array(p[1:], float)], 1) for p in paths)])
    inside = [p for p in planar.faces(planar.cut_edges(e)) if planar.inside(np.array([planar.inner_point(p)]), planar.edges_of([ring]))[0]]
    return sorted(round(planar.area_of(p), 6) for p in inside)


CASES = [
    ([], [100]),
    ([[(-1, 4), (11, 4)]], [40, 60]),
    ([[(-1, 4), (5, 4)]], [100]),  # ends inside
    ([[(-1, 4), (5, 4), (5, 11)]], [30, 70]),  # bends inside
    ([[(-1, 4), (11, 4)], [(3, -1), (3, 11)]], [12, 18, 28, 42]),
    ([[(-1, 2), (11, 2), (11, 8), (-1, 8)]], [20, 20, 60]),  # enters twice
    ([[(-1, 4), (11, 4)], [(-1, 4), (11, 4)]], [40, 60]),  # repeated
    ([[(0, 0), (10, 10)]], [50, 50]),  # through corners
    ([[(0, 4), (10, 4)]], [40, 60]),  # from border to border
    ([[(0, 0), (5, 0), (5, 10)]], [50, 50]),  # along the border and in
    ([[(-1, 5), (5, 5)], [(5, 5), (5, 11)]], [25, 75]),  # two that meet inside
    ([[(-1, 5), (11, 5)], [(5, 5), (5, 11)]], [25, 25, 50]),  # a T
    ([[(3, 3), (5, 3), (5, 5), (3, 5), (3, 3)]], [4, 96]),  # an island
    ([[(0, 5), (3, 5), (3, 3), (5, 3), (5, 5), (3, 5)]], [4, 96]),  # an island on a causeway
    ([[(-1, 4), (11, 4)], [(4, 4), (6, 4)]], [40, 60]),  # overlap
]


@pytest.mark.parametrize(("paths", "want"), CASES)
def test_faces(paths, want):
    assert areas(paths) == want


def test_faces_of_random_barriers_add_up():
    draw = np.random.default_rng(1)
    for _ in range(150):
        paths = [draw.uniform(-2, 12, (draw.integers(2, 6), 2)) for _ in range(draw.integers(1, 8))]
        paths = [np.round(p) for p in paths] if draw.random() < 0.5 else paths
        assert sum(areas(paths)) == pytest.approx(100, abs=1e-3)


def test_concave_ring():
    ring = np.array([[0, 0], [9, 0], [9, 9], [6, 9], [6, 3], [3, 3], [3, 9], [0, 9]], float)
    assert areas([[(-1, 6), (10, 6)]], ring) == [9, 9, 45]


def test_segments_in_spark_match_faces(spark):
    rows = [(i, rings(SQUARE + [20 * i, 0])) for i in range(len(CASES))]
    use = spark.createDataFrame(rows + rows[:2] + [(100, None), (101, []), (None, rows[0][1])], f"id long, rings {RINGS}")
    lines = [(1000 * i + k, [(float(x + 20 * i), float(y)) for x, y in p]) for i, (paths, _) in enumerate(CASES) for k, p in enumerate(paths)]
    walls = spark.createDataFrame(lines + lines[:3] + [(5, None), (6, [])], "id long, pts array<struct<x double, y double>>")
    got = {}
    for r in segments.between_barriers(use, walls, "id", 7.0).withColumn("own", polygon_area(F.array("rings"))).collect():
        got.setdefault(r["id"], []).append(round(r["area"], 6))
        assert r["own"] == pytest.approx(r["area"])
    assert {k: sorted(v) for k, v in got.items()} == {i: want for i, (_, want) in enumerate(CASES)}


def test_segments_with_holes_codes_and_sizes(spark):
    hole = np.array([[4, 4], [4, 6], [6, 6], [6, 4]], float)
    use = spark.createDataFrame([(0, "11", rings(SQUARE, hole)), (1, "2", rings(SQUARE + 20)), (2, "1+", rings(SQUARE + 40))], f"id long, code string, rings {RINGS}")
    walls = spark.createDataFrame([(1, [(-1.0, 5.0), (11.0, 5.0)])], "id long, pts array<struct<x double, y double>>")
    made = segments.create_segments(use, walls, 7.0, ["1"], 15.0)
    assert sorted((r["id"], r["code"], r["area"]) for r in made.collect()) == [(0, "11", 48.0), (0, "11", 48.0), (2, "1+", 100.0)]
    assert segments.create_segments(use, walls, 7.0, ["1+"], 15.0).count() == 1, "prefixes are plain text"
    assert segments.create_segments(use, walls, 7.0, [], 15.0).count() == 0
    small = segments.create_segments(use, walls, 7.0, ["1"], 1.0, most_area=30.0, most_wagner=2.0).collect()
    assert all(r["area"] < 30 for r in small) and sum(r["area"] for r in small) == pytest.approx(196)
    assert len({(r["id"], r["part"]) for r in small}) == len(small)


def test_subdivision_of_concave_shapes_and_holes(spark):
    draw = np.random.default_rng(2)
    ell = np.array([[0, 0], [30, 0], [30, 10], [10, 10], [10, 30], [0, 30]], float)
    you = np.array([[0, 0], [9, 0], [9, 9], [6, 9], [6, 3], [3, 3], [3, 9], [0, 9]], float) * 4
    shapes = {"l": [ell], "u": [you], "cw": [ell[::-1]], "closed": [np.concatenate([ell, ell[:1]])]}
    for k in range(8):
        a = np.sort(draw.uniform(0, 2 * np.pi, draw.integers(5, 40)))
        far = draw.uniform(5, 30, len(a))
        shapes[f"star{k}"] = [np.stack([far * np.cos(a), far * np.sin(a)], 1)]
    square = np.array([[0, 0], [40, 0], [40, 40], [0, 40]], float)
    shapes["holes"] = [square, *(np.array([[a, b], [a, b + 6], [a + 6, b + 6], [a + 6, b]], float) for a in (5, 20) for b in (5, 25))]
    df = spark.createDataFrame([(k, rings(*v)) for k, v in shapes.items()] + [("null", None), ("empty", []), ("flat", rings([(0, 0), (1, 1), (2, 2)]))], f"k string, rings {RINGS}")
    rows = subdivide.subdivide(df, "k", "rings", 80.0, 1.5, 0.0).withColumn("own", polygon_area(F.array("rings"))).collect()
    for k, v in shapes.items():
        mine = [r for r in rows if r["k"] == k]
        assert sum(r["area"] for r in mine) == pytest.approx(planar.area_of(v), rel=1e-5)
        assert all(0 < r["area"] < 80 and r["own"] == pytest.approx(r["area"]) for r in mine)
        for r in mine:
            shape = [np.array([[p["x"], p["y"]] for p in ring]) for ring in r["rings"]]
            assert planar.inside(np.array([[r["x"], r["y"]]]), planar.edges_of(shape))[0]
            assert len(planar.faces(planar.cut_edges(planar.edges_of(shape[:1])))) == 1, "parts are simple rings"
    assert not [r for r in rows if r["k"] in ("null", "empty", "flat")]
    whole = subdivide.subdivide(df.where("k = 'holes'"), "k", "rings", 1e6, 99.0).collect()
    assert [len(r["rings"]) for r in whole] == [5]


def test_simplified_rings():
    ring = np.array([[0, 0], [5, 0], [10, 0], [10, 10], [9.99, 10], [0, 10], [0, 5]], float)
    assert subdivide.simplified(ring).tolist() == [[0, 0], [10, 0], [10, 10], [0, 10]]
    assert len(subdivide.simplified(ring, 0.1)) == 4


def test_overlay_areas_match_shapes(spark):
    """Concave polygons, holes, clockwise rings and repeated rows: areas by triangles equal those of the clipped faces."""
    draw = np.random.default_rng(7)

    def star(x, y):
        a = np.sort(draw.uniform(0, 2 * np.pi, draw.integers(4, 12)))
        far = draw.uniform(5, 20, len(a))
        return np.stack([x + far * np.cos(a), y + far * np.sin(a)], 1)

    left = [(i, rings(star(*draw.uniform(0, 60, 2))[:: -1 if i % 2 else 1])) for i in range(12)]
    right = [(i, rings(star(*draw.uniform(0, 60, 2)))) for i in range(12)]
    right.append((99, rings(SQUARE * 4, (SQUARE * 2 + 5)[::-1])))
    a, b = spark.createDataFrame(left + left[:3] + [(50, None)], f"a long, rings {RINGS}"), spark.createDataFrame(right + right[:2], f"b long, rings {RINGS}")
    got = {(r["a"], r["b"]): r["piece_area"] for r in spatial.overlay(a, b, "a", "b", 15.0).collect()}
    cut = parcels.clipped_polygons(a, b, "a", "b", 15.0).groupBy("a", "b").agg(F.sum("area").alias("s")).collect()
    shapes = {(r["a"], r["b"]): r["s"] for r in cut if r["s"] > 1e-4}
    assert shapes.keys() <= got.keys() and len(shapes) > 10
    for k, v in got.items():
        assert v == pytest.approx(shapes.get(k, 0.0), abs=2e-4)


def test_points_that_repeat(spark):
    points = spark.createDataFrame([(1, 5.0, 5.0), (1, 5.0, 5.0), (2, 50.0, 5.0), (3, 5.0, 5.0), (3, 90.0, 5.0)], "k long, x double, y double")
    shapes = spark.createDataFrame([(7, rings(SQUARE)), (7, rings(SQUARE)), (8, rings(SQUARE, SQUARE / 2 + 2)), (9, None)], f"p long, rings {RINGS}")
    got = spatial.points_in_polygons(points, shapes, "k", "p", 3.0).collect()
    assert sorted(map(tuple, got)) == [(1, 7), (3, 7)]
    near = parcels.nearest_polygon(points, shapes.where("p = 7"), "k", "p").collect()
    assert sorted(map(tuple, near)) == [(1, 7, 0.0), (3, 7, 0.0)]


def test_crowded_bins_give_the_same_pairs(spark):
    draw = np.random.default_rng(5)
    a = [(i, *draw.uniform(0, 1, 2).tolist()) for i in range(200)] + [(i, *draw.uniform(0, 40, 2).tolist()) for i in range(200, 400)]
    b = [(i, *draw.uniform(0, 40, 2).tolist()) for i in range(60)]
    left, right = spark.createDataFrame(a, "k long, x double, y double"), spark.createDataFrame(b, "o long, px double, py double")
    want = sorted((k, o) for k, x, y in a for o, px, py in b if math.hypot(x - px, y - py) <= 3)
    for dense in (50_000, 20):
        got = spatial.within_range(left, right, 3.0, dense=dense)
        assert sorted((r["k"], r["o"]) for r in got.collect()) == want and "__s" not in got.columns


def test_roads_cut_at_the_buffer(spark):
    built = spark.createDataFrame([(1, rings(SQUARE * 10)), (2, rings([(150, 130), (250, 130), (200, 200)]))], f"id long, rings {RINGS}")
    draw = np.random.default_rng(9)
    roads = [(i, *draw.uniform(-100, 300, 4).tolist()) for i in range(25)] + [(99, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(roads, "k long, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for r in parcels.split_built_up(df, built, "k", "id", 20.0).collect():
        got.setdefault(r["k"], []).append(r)
    shapes = [SQUARE * 10, np.array([[150, 130], [250, 130], [200, 200]], float)]

    def within(x, y):
        for s in shapes:
            e = planar.edges_of([s])
            v, w = e[:, 2:] - e[:, :2], np.array([x, y]) - e[:, :2]
            t = np.clip((v * w).sum(1) / (v * v).sum(1), 0, 1)
            if planar.inside(np.array([[x, y]]), e)[0] or np.hypot(*(w - t[:, None] * v).T).min() <= 20:
                return 1
        return 0

    for k, x1, y1, x2, y2 in roads[:-1]:
        bits = sorted(got[k], key=lambda r: r["bit"])
        assert (bits[0]["x1"], bits[0]["y1"], bits[-1]["x2"], bits[-1]["y2"]) == (x1, y1, x2, y2)
        assert all(p["builtup"] != q["builtup"] and (p["x2"], p["y2"]) == (q["x1"], q["y1"]) for p, q in zip(bits, bits[1:], strict=False))
        for b in bits:
            for t in (0.01, 0.3, 0.5, 0.8, 0.99):
                assert within(b["x1"] + t * (b["x2"] - b["x1"]), b["y1"] + t * (b["y2"] - b["y1"])) == b["builtup"]
    assert 99 not in got


def test_self_intersections(spark):
    bow, eight = [(0, 0), (10, 10), (10, 0), (0, 10)], [(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2)]
    rows = [(1, rings(bow)), (1, rings(bow)), (2, rings(SQUARE)), (3, rings(eight)), (4, rings(SQUARE, SQUARE / 2)), (5, rings([*SQUARE.tolist(), (0, 0)])), (6, None)]
    got = {r["k"]: r["crossings"] for r in planar.self_intersections(spark.createDataFrame(rows, f"k long, rings {RINGS}"), "k", 4.0).collect()}
    assert got.keys() == {1, 3, 4} and got[1] == 1


def test_dissolved_lines(spark):
    from parcelwise.operators import layers

    chain = [("a", float(i), 0.0, float(i + 1), 0.0) for i in range(40)]
    chain = [(c, x2, y2, x1, y1) if i % 3 else (c, x1, y1, x2, y2) for i, (c, x1, y1, x2, y2) in enumerate(chain)]
    fork = [("a", 20.0, 0.0, 20.0, 7.0), ("b", 30.0, 0.0, 30.0, 7.0)]
    ring = [("c", 0.0, 50.0, 4.0, 50.0), ("c", 4.0, 50.0, 4.0, 53.0), ("c", 4.0, 53.0, 0.0, 50.0)]
    lasso = [("d", -3.0, 50.0, 0.0, 50.0), *(("d", *e[1:]) for e in ring)]
    rows = chain + fork + ring + lasso + chain[:5] + [("a", 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "class string, x1 double, y1 double, x2 double, y2 double").repartition(5)
    got = sorted((r["class"], round(r["length"], 6), len(r["pts"])) for r in layers.dissolved(df, ["class"]).collect())
    assert got == [("a", 7.0, 2), ("a", 20.0, 21), ("a", 20.0, 21), ("b", 7.0, 2), ("c", 12.0, 4), ("d", 3.0, 2), ("d", 12.0, 4)]
    assert layers.dissolved(df.limit(0), ["class"]).count() == 0
