"""Exact ranks, raster blocks, costs, rings of ways, models with components, whole feature tables, and clipped integration."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.jobs import pipelines
from parcelwise.operators import allocate, models, network, parcels, ranks, raster
from parcelwise.sources import geojson, osm
from tests.core.test_integrate import XML


def test_ranks_with_nan_and_infinities(spark):
    draw = random.Random(4)
    data = {"a": [draw.gauss(0, 1e6) for _ in range(3_000)] + [float("nan")], "b": [float("-inf")] * 3 + [1.5] * 500 + [float("inf")] * 4, "c": [7.0], "d": [-0.0, 0.0, 5e-324, -5e-324, 1e-310], "e": [1e308, -1e308, 3.0]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("a", None), (None, 1.0)], "g string, v double").repartition(3)
    wanted = (0.0, 0.5, 0.025, 0.975, 1.0)
    got = ranks.order_statistics(df, "g", "v", wanted)
    assert got.keys() == data.keys()
    for g, vs in data.items():
        ordered = sorted(vs, key=lambda v: (math.isnan(v), v))
        for q in wanted:
            at = q * (len(vs) - 1)
            low, high = ordered[int(at)], ordered[min(int(at) + 1, len(vs) - 1)]
            want = low if low == high or at == int(at) else low + (high - low) * (at - int(at))
            assert got[g][q] == pytest.approx(want, nan_ok=True)
    assert ranks.order_statistics(df.limit(0), "g", "v", wanted) == {}
    rows = allocate.descriptors(spark.createDataFrame([(1.0, float("nan"))] * 1_500 + [(2.0, 3.0)], "model double, real double")).collect()
    assert len(rows) == 4


def test_many_ranks_in_few_counts(spark, monkeypatch):
    monkeypatch.setattr(ranks, "COUNTS", 1 << 10)
    values = [math.sin(i) * 10 ** (i % 9) for i in range(4_000)]
    df = spark.createDataFrame([(0, v) for v in values], "g int, v double")
    at = tuple(k / 300 for k in range(300))
    got = ranks.order_statistics(df, "g", "v", at)[0]
    want = np.quantile(values, at)
    assert all(got[q] == pytest.approx(w, rel=1e-12) for q, w in zip(at, want, strict=True))


def test_windows_over_block_borders(spark, monkeypatch):
    monkeypatch.setattr(raster, "BLOCK", 32)
    draw = np.random.default_rng(3)
    grid = {(i, j): float(draw.integers(0, 50)) for i in range(-6, 70) for j in range(-5, 40) if draw.random() < 0.9}
    empty = set(list(grid)[::11])
    rows = [(i, j, None if (i, j) in empty else v) for (i, j), v in grid.items()]
    cells = spark.createDataFrame(rows, "i long, j long, value double")
    there = {k: v for k, v in grid.items() if k not in empty}
    around = lambda i, j, offsets: [(there[i + a, j + b], *w) for a, b, *w in offsets if (i + a, j + b) in there]
    disc = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if math.hypot(a, b) <= 2]
    got = {(r["i"], r["j"]): r["value"] for r in raster.focal_median(cells, 2.0, 1.0).collect()}
    want = {k: float(np.median([v[0] for v in near])) for k in grid if (near := around(*k, disc))}
    assert got == want
    cross = [(0, 0, 2.0), (0, 1, 1.0), (-3, 0, 0.5)]
    got = {(r["i"], r["j"]): r["value"] for r in raster.focal_mean(cells, cross).collect()}
    want = {k: sum(v * w for v, w in near) / sum(w for _, w in near) for k in grid if (near := around(*k, cross))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    for mask in (raster.gaussian_mask(1.0, 1.0, 2.0), [(1, 0, 0.5), (0, 2, 0.25), (-1, -1, 0.1)]):
        sums = {}
        for (i, j), v in there.items():
            for a, b, w in mask:
                key = (i - a, j - b, int(v) % 3)
                sums[key] = sums.get(key, 0.0) + w
        found = raster.neighbour_sums(cells.select("i", "j", (F.col("value").cast("int") % 3).alias("code")), mask, "code").collect()
        assert {(r["i"], r["j"], r["code"]) for r in found} == sums.keys()
        assert all(r["w"] == pytest.approx(sums[r["i"], r["j"], r["code"]]) for r in found)
    assert raster.focal_median(cells.limit(0), 2.0, 1.0).count() == 0


def test_costs_of_a_chain_and_too_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(network, "LOGGED", 3)
    chain = spark.createDataFrame([(i, i + 1, 1.0 + i % 3) for i in range(14)] + [(0, 14, 100.0)], "src long, dst long, cost double")
    goal = spark.createDataFrame([(14,), (14,), (None,)], "target long")
    got = {r["v"]: r["cost"] for r in network.cost_matrix(chain, goal).collect()}
    assert got == {i: float(sum(1 + k % 3 for k in range(i, 14))) for i in range(15)}
    for width in (0.5, 2.0, 1_000.0):
        assert {r["v"]: r["cost"] for r in network.cost_matrix(chain, goal, width=width).collect()} == got
    with pytest.raises(RuntimeError, match="rounds"):
        network.cost_matrix(chain, goal, rounds=5)
    assert network.cost_matrix(chain, goal.limit(0)).count() == 0


def test_rings_of_many_ways():
    n = 50_000
    ways = [([i, (i + 1) % n], [(math.cos(i), math.sin(i)), (math.cos(i + 1), math.sin(i + 1))]) for i in range(n)]
    random.Random(2).shuffle(ways)
    ways = [(r[::-1], p[::-1]) if k % 3 == 0 else (r, p) for k, (r, p) in enumerate(ways)]
    (refs, pts), = osm.stitch(ways)
    assert len(refs) == len(pts) == n + 1 and refs[0] == refs[-1] and len(set(refs)) == n
    assert all(abs(a - b) in (1, n - 1) for a, b in zip(refs, refs[1:], strict=False))
    two = osm.stitch([([1, 2, 3], "abc"), ([3, 4, 1], "cda"), ([3, 5, 6], "cef"), ([6, 7, 3], "fgc")])
    assert sorted(len(r) for r, _ in two) == [5, 5], "rings that touch at a place are two"
    assert osm.stitch([([1, 2], "ab"), ([2, 3], "bc")]) is None
    assert [r for r, _ in osm.stitch([([1, 2, 1], "aba"), ([4, 5, 6, 4], "defd")])] == [[4, 5, 6, 4]]


def _training(spark):
    draw = random.Random(3)
    rows = [(i, a := draw.uniform(0, 9), 2 * a + draw.uniform(0, 1), draw.uniform(1, 5), 0.0, 3 * a - draw.uniform(0, 2)) for i in range(120)]
    return spark.createDataFrame(rows + [(999, None, 1.0, 1.0, 0.0, 1.0)], "id long, FFa double, FFb double, FFc double, FFzero double, target double")


def test_models_with_components_and_weights(spark, tmp_path):
    df = _training(spark)
    plain = pipelines.train(df)
    for weights, pca in ((None, True), ({"FFb": 4.0}, True), ({"FFb": 0.5}, False)):
        model = pipelines.train(df, weights=weights, pca=pca)
        assert model.excluded == ["FFzero"]
        for a, b, s, q in zip(model.coef, plain.coef, model.scale, plain.scale, strict=True):
            assert a / s == pytest.approx(b / q, rel=1e-6)
        assert model.intercept == pytest.approx(plain.intercept, rel=1e-6)
    cut = pipelines.train(df, pca=0.9)
    assert cut.coef != pytest.approx(plain.coef, rel=1e-3)
    left = pipelines.train(df, weights={"FFc": 0.0})
    assert left.features == ["FFa", "FFb"] and "FFc" in left.excluded
    ard = pipelines.train(df, kind="ard", pca=True)
    assert models.apply_linear(df, ard).where("FFa is not null").agg(F.corr("score", "target")).first()[0] > 0.98
    kernel = pipelines.train(df, kind="general", pca=True)
    assert isinstance(kernel, models.KernelModel) and 0 < kernel.sigma < 10
    kernel.save(str(tmp_path / "m"))
    again = models.KernelModel.load(spark, str(tmp_path / "m"))
    one, two = ({r["id"]: r["weight"] for r in pipelines.score(df, m, "id").collect()} for m in (kernel, again))
    assert one == pytest.approx(two) and one[999] is None
    same = models.fit_general(df, ["FFa", "FFb"], "target", 0.2)
    rows = [r for r in df.collect() if r["FFa"] is not None]
    ma, mb = max(r["FFa"] for r in rows), max(r["FFb"] for r in rows)
    got = {r["id"]: r["score"] for r in models.score_general(df, same, "id").collect()}
    for q in rows[:10]:
        w = [math.exp(-(abs(q["FFa"] - t["FFa"]) / ma + abs(q["FFb"] - t["FFb"]) / mb) / 0.2) for t in rows]
        assert got[q["id"]] == pytest.approx(sum(a * t["target"] for a, t in zip(w, rows, strict=True)) / sum(w))


def boxes(spark, rows, more=""):
    df = spark.createDataFrame(rows, f"id long, x double, y double, w double, h double{more}")
    return df.withColumn("rings", parcels.rectangle(F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def test_all_layers_of_a_configuration(spark):
    segments = boxes(spark, [(1, 0.0, 0.0, 100.0, 100.0), (2, 200.0, 0.0, 100.0, 50.0), (3, 3000.0, 3000.0, 20.0, 20.0)]).select(F.col("id").alias("seg_id"), (F.col("w") * F.col("h")).alias("area"), "rings")
    building = boxes(spark, [(1, 10.0, 10.0, 20.0, 20.0), (2, 210.0, 10.0, 10.0, 10.0)]).select("id", (F.col("w") * F.col("h")).alias("AREA"), F.lit(1.1).alias("WAG"), "rings", (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py"))
    ua = boxes(spark, [(1, -50.0, -50.0, 200.0, 200.0, "11"), (2, 150.0, -50.0, 200.0, 200.0, "20")], ", code string").select("id", "code", "rings")
    poi = spark.createDataFrame([(1, "pub", 50.0, 50.0)], "id long, subtype string, x double, y double")
    kind = "array<struct<x double, y double>>"
    roads = spark.createDataFrame([(1, "street", 0, None, [(-50.0, 20.0), (400.0, 20.0)]), (2, "street", 0, None, [(150.0, -50.0), (150.0, 150.0)])], f"line long, class string, level int, oneway boolean, pts {kind}")
    barrier = spark.createDataFrame([(1, 2.0, [(0.0, 60.0), (100.0, 60.0)])], f"id long, repellence double, pts {kind}")
    dem = spark.range(-5 * 20, 400).select(F.floor(F.col("id") / 20).alias("i"), F.pmod("id", F.lit(20)).alias("j")).withColumn("value", F.col("j") * 3.0)
    groups = {"food": ["pub"]}
    config = {
        "side": 50.0, "points": {"most_area": 2_000.0, "most_wagner": 2.0, "least_area": 250.0}, "buildings": {}, "building_proximity": {"sd": 20.0}, "landuse": {"codes": ["11", "2"]},
        "landuse_proximity": {"codes": ["11", "2"], "sd": 20.0, "resolution": 25.0}, "poi": {"groups": groups}, "poi_proximity": {"groups": groups, "sd": 20.0},
        "transport": {"speeds": {0: {"street": 50}, 1: {"street": 30}}, "builtup": ["11"], "tolerance": 150.0}, "barrier": {"cell": 10.0, "radius": 20.0}, "dem": {"size": 30.0, "smoothing": 30.0},
    }
    layers = {"building": building, "ua": ua, "poi": poi, "transport": roads, "barrier": barrier, "dem": dem}
    got = {r["seg_id"]: r for r in parcels.calculate(segments, layers, config).collect()}
    wanted = {"FFcbsize_sum", "FFcbwag_wmedian", "FFpbsize_sum", "FFcluf11", "FFpluf11", "FFcpfood", "FFppfood", "FFacc", "FFrepel", "FFslope", "FFwest", "FFsouth", "FFhperc"}
    assert len(got) == 3 and wanted <= set(got[1].asDict())
    assert got[1]["FFcbsize_sum"] == pytest.approx(400 / 10_000), "sums are per area of the segment"
    assert got[1]["FFcluf11"] == 1.0 and got[2]["FFcluf2"] == 1.0 and got[1]["FFpluf11"] > 0.9 and 0 < got[2]["FFpluf2"] <= 1
    assert got[1]["FFrepel"] > 0 and got[2]["FFrepel"] == 0 and got[1]["FFacc"] > 0 and got[2]["FFacc"] > 0
    assert got[1]["FFslope"] == pytest.approx(math.degrees(math.atan(0.1)), rel=0.35) and got[3]["FFslope"] == 0 == got[3]["FFacc"]
    # A point's value counts by its area: plain means of the points' own sums.
    points = parcels.points_of(segments, **config["points"]).collect()
    mine = [p for p in points if p["point"]["seg_id"] == 1]
    near = lambda p: math.exp(-((p["x"] - 50) ** 2 + (p["y"] - 50) ** 2) / 800) if math.hypot(p["x"] - 50, p["y"] - 50) <= 100 else 0.0
    assert got[1]["FFppfood"] == pytest.approx(sum(near(p) * p["WT_AREA"] for p in mine) / 10_000)


def test_integrate_within_a_study_area(spark, tmp_path):
    path = tmp_path / "map.osm"
    path.write_text(XML)
    config = {"layers": {"all": {"selector": {"landuse": True}, "attributes": [{"name": "landuse", "getter": {"get": "landuse"}}]}, "poi": {"selector": {"amenity": True}, "attributes": [{"name": "amenity", "getter": {"get": "amenity"}}]}}}
    whole = {r["id"]: r for r in pipelines.integrate(spark, str(path), config, 3.0)["all"].collect()}
    xs = [p["x"] for part in whole[20]["geometry"]["parts"] for ring in part for p in ring]
    ys = [p["y"] for part in whole[20]["geometry"]["parts"] for ring in part for p in ring]
    middle = (min(xs) + max(xs)) / 2
    study = boxes(spark, [(1, middle, min(ys) - 10, max(xs), max(ys) - min(ys) + 20)]).select("id", "rings")
    found = pipelines.integrate(spark, str(path), config, 3.0, study, 100_000.0)
    cut = {r["id"]: r["geometry"] for r in found["all"].collect()}
    inside = [p["x"] for g in cut.values() for part in g["parts"] for ring in part for p in ring]
    assert cut.keys() == whole.keys() and min(inside) >= middle - 1e-3 and cut[10]["type"] == "LineString"
    assert found["poi"].count() == 0, "the point lies outside"
    far = boxes(spark, [(1, 9e7, 9e7, 1.0, 1.0)]).select("id", "rings")
    assert pipelines.integrate(spark, str(path), config, 3.0, far, 100_000.0)["all"].count() == 0
    parts = pipelines.integrate_parts(spark, [str(path)], config, 3.0, str(tmp_path / "out"))
    again = pipelines.integrate_parts(spark, [str(path)], config, 3.0, str(tmp_path / "out"))
    assert parts["all"].count() == again["all"].count() == 3


def test_layers_with_converters_and_order(spark):
    df = spark.createDataFrame([(2, "b"), (None, "c"), (1, "a")], "k long, v string")
    out = geojson.layer(df, {"id": "k", "name": "v"}, "v != 'b'", {"kind": 7}, {"name": F.upper}, ["id"])
    assert [tuple(r) for r in out.collect()] == [(None, "C", 7), (1, "A", 7)]
