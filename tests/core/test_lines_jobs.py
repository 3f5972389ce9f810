import math

import pytest
from pyspark.sql import functions as F

from parcelwise.jobs import pipelines
from parcelwise.operators import lines, recipes, subdivide

KIND = "id int, pts array<struct<x:double,y:double>>"


def test_routable_cuts(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0)]), (2, [(5.0, -5.0), (5.0, 5.0)]), (3, [(2.0, -5.0), (2.0, 5.0)]), (4, [(8.0, 0.05), (8.0, 9.0)])], KIND)
    levels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "line int, level int")
    got = lines.routable(lines.edges(df, "id"), levels, 4.0)
    by = {}
    for r in got.collect():
        by.setdefault(r["line"], []).append(round(r["length"], 6))
    assert sorted(by[1]) == [2.0, 3.0, 5.0] and sorted(by[2]) == [5.0, 5.0] and by[3] == [10.0] and len(by[4]) == 1


def test_snap_and_density(spark):
    e = lines.edges(spark.createDataFrame([(1, [(0.0, 0.0), (100.0, 0.0)])], KIND), "id")
    points = spark.createDataFrame([(7, 30.0, 4.0), (8, 30.0, 40.0)], "p int, px double, py double")
    got = lines.snapped(points, e, "p", 10.0).collect()
    assert [(r["p"], r["t"], r["distance"]) for r in got] == [(7, 0.3, 4.0)]
    d = lines.density(e, spark.createDataFrame([(1, 2.0)], "line int, weight double"), 10.0, 20.0)
    mid = {(r["i"], r["j"]): r["value"] for r in d.collect()}[(0, 5)]
    chord = 2 * math.sqrt(20**2 - 5**2)
    assert mid == pytest.approx(2 * chord / (math.pi * 400) * 1e6, rel=0.1)


def test_subdivide_covers_and_limits(spark):
    ring = [(0.0, 0.0), (40.0, 0.0), (40.0, 10.0), (10.0, 10.0), (10.0, 40.0), (0.0, 40.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1, ring), (2, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])], KIND)
    got = subdivide.subdivide(df, "id", "pts", 60.0, 2.0).collect()
    for k, area in ((1, 700.0), (2, 0.5)):
        own = [r["area"] for r in got if r["id"] == k]
        assert sum(own) == pytest.approx(area) and max(own) < 60
    for r in got:
        if r["id"] == 1:
            assert (0 <= r["x"] <= 40 and 0 <= r["y"] <= 10) or (0 <= r["x"] <= 10 and 0 <= r["y"] <= 40)


def test_train_apply_validate(spark):
    seg = spark.createDataFrame([(i, float(i), float(i % 3), 10.0) for i in range(1, 13)], "seg_id int, FFa double, FFb double, area double")
    ready = pipelines.prepare_training(seg, seg.select("seg_id", (F.col("FFa") * 3 + F.col("FFb") + 2).alias("v")), "seg_id", "v", "area", False)
    model = pipelines.train(ready)
    pieces = seg.select("seg_id", F.floor(F.col("seg_id") / 5).alias("area_id"), F.col("area").alias("piece_area"), F.lit(100.0).alias("main"))
    out = pipelines.apply_model(seg, model, pieces, "seg_id", "area_id", "main", True)
    assert all(r["s"] == pytest.approx(100.0) for r in out.groupBy("area_id").agg(F.sum("value").alias("s")).collect())
    checked = out.select("seg_id", F.col("area_id").cast("long").alias("k"), "piece_area", "value", F.lit(100.0).alias("real"))
    truth = spark.createDataFrame([(0, 100.0), (1, 100.0), (2, 100.0), (9, 5.0)], "k long, real double")
    errors, _ = pipelines.validate(checked, truth, "k", "seg_id", "value", "real", "piece_area")
    assert errors.first()["tae"] == pytest.approx(5.0)


def test_recipes(spark):
    pieces = spark.createDataFrame([(1, "1121", 3.0, 50.0, 1.2), (1, "31", 1.0, 70.0, 1.5)], "seg_id int, code string, piece_area double, AREA double, WAG double")
    assert recipes.land_use(pieces, ["1121", "3"]).first()["FFcluf1121"] == 0.75
    assert recipes.buildings(pieces).first()["FFcbsize_sum"] == 120.0
    pois = spark.createDataFrame([(1, "bus", 2.0), (1, "tram", 2.0), (1, "x", 2.0)], "seg_id int, subtype string, area double")
    assert recipes.poi_use(pois, {"pubtrn": ["bus", "tram"]}).first()["FFcppubtrn"] == 1.0
    seg = spark.createDataFrame([(1,), (2,)], "seg_id int")
    wide = recipes.widened(seg, [recipes.land_use(pieces, ["1121"])])
    assert {r["seg_id"]: r["FFcluf1121"] for r in wide.collect()} == {1: 0.75, 2: 0.0}
