"""Layer upkeep, parcels and kernel models on small tables, odd rows among them."""

import math

import pytest
from pyspark.sql import functions as F

from parcelwise.jobs import pipelines
from parcelwise.operators import layers, models, parcels


def test_flags_and_inverse_split_the_rows(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 1)], "id long, v int")
    assert [r["big"] for r in layers.flagged(df, F.col("v") > 2, "big").orderBy("id").collect()] == [True, False, False]
    assert sorted(r["id"] for r in layers.rejected(df, F.col("v") > 2).collect()) == [2, 3]
    assert layers.reshaped(df, ["id"], {"w": "v"}, {"x": F.col("v") * 2}, {"e": "double"}).dtypes == [("id", "bigint"), ("w", "int"), ("x", "int"), ("e", "double")]


def test_types_by_majority(spark, tmp_path):
    rows = [(1, "1", "1.5", "x", None), (2, "2", "2", "3", None), (3, "a", "2.5", "y", None), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string, d string")
    got = layers.inferred(df, "id", ["a", "b", "c", "d"])
    assert dict(got.dtypes) == {"id": "bigint", "a": "bigint", "b": "double", "c": "string", "d": "string"}
    assert [r["a"] for r in got.orderBy("id").collect()] == [1, 2, None, None]
    layers.write_layer(df, str(tmp_path / "l"), {"id": "key", "a": "n", "b": "m"}, {"m": "int"}, "key")
    assert dict(spark.read.parquet(str(tmp_path / "l")).dtypes) == {"key": "bigint", "n": "bigint", "m": "int"}


def test_last_and_largest_with_ties(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 2, 7), (2, None, 3)], "k long, o int, v int")
    assert {(r["k"], r["v"]) for r in layers.last_values(df, ["k"], "v", ["o"]).collect()} == {(1, 7), (2, 3)}
    top = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "a", 1)], "g long, k string, v long")
    assert [tuple(r) for r in layers.top_key(top, "g", "k", "v").collect()] == [(1, "a", 2)]
    assert layers.last_values(df.limit(0), ["k"], "v", ["o"]).count() == 0
    assert {tuple(r) for r in layers.neighbours(spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "a long, b long"), "a", "b").collect()} == {(1, 2), (2, 1)}
    e = spark.createDataFrame([("r", 0.0, 0.0, 1.0, 1.0), ("r", 1.0, 1.0, 0.0, 0.0), ("s", 0.0, 0.0, 1.0, 1.0)], "class string, x1 double, y1 double, x2 double, y2 double")
    assert layers.homogenised(e, ["class"]).count() == 2


def boxes(spark, rows, more=""):
    df = spark.createDataFrame(rows, f"id long, x double, y double, w double, h double{more}")
    return df.withColumn("rings", parcels.rectangle(F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def test_features_of_a_configuration(spark):
    segments = boxes(spark, [(1, 0.0, 0.0, 10.0, 10.0), (2, 10.0, 0.0, 10.0, 10.0), (3, 500.0, 500.0, 10.0, 10.0)]).select(F.col("id").alias("seg_id"), F.lit(100.0).alias("area"), "rings", (F.col("x") + 5).alias("x"), (F.col("y") + 5).alias("y"))
    building = boxes(spark, [(1, 2.0, 2.0, 4.0, 4.0), (2, 8.0, 1.0, 4.0, 2.0)]).select("id", F.col("w") * F.col("h"), F.lit(1.1), "rings", F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2).toDF("id", "AREA", "WAG", "rings", "px", "py")
    ua = boxes(spark, [(1, 0.0, 0.0, 14.0, 10.0, "11"), (2, 14.0, 0.0, 6.0, 10.0, "20")], ", code string").select("id", "code", "rings")
    poi = spark.createDataFrame([(1, "pub", 1.0, 1.0), (2, "pub", 4.0, 1.0), (3, "school", 12.0, 2.0)], "id long, subtype string, x double, y double")
    groups = {"food": ["pub"], "learn": ["school"]}
    config = {"side": 20.0, "buildings": {}, "building_proximity": {"sd": 1.5}, "landuse": {"codes": ["11", "20"]}, "poi": {"groups": groups}, "poi_proximity": {"groups": groups, "sd": 2.0}}
    got = {r["seg_id"]: r for r in parcels.calculate(segments, {"building": building, "ua": ua, "poi": poi}, config).collect()}
    assert got[1]["FFcbsize_sum"] == 0.24 and got[2]["FFcbsize_sum"] == 0.08 and got[3]["FFcbsize_sum"] == 0.0, "per area of the segment"
    assert (got[1]["FFcluf11"], got[2]["FFcluf11"], got[2]["FFcluf20"]) == (1.0, pytest.approx(0.4), pytest.approx(0.6))
    assert got[1]["FFcpfood"] == pytest.approx(0.02) and got[2]["FFcplearn"] == pytest.approx(0.01) and got[3]["FFcpfood"] == 0.0
    assert got[1]["FFppfood"] == pytest.approx(math.exp(-32 / 8) + math.exp(-17 / 8))
    assert got[1]["FFpbsize_sum"] == 24.0 and got[2]["FFpbsize_mean"] == 8.0
    coded = parcels.coded(segments, ua, "seg_id", "code", 20.0, ["11"], 50.0)
    assert {(r["seg_id"], r["code"]) for r in coded.collect()} == {(1, "11")}
    assert parcels.coded(segments, ua, "seg_id", "code", 20.0, ["11"], 100.0).count() == 0


def test_dual_training_values(spark):
    segments = spark.createDataFrame([(i, 2e6) for i in range(1, 6)], "seg long, area double")
    polygons = spark.createDataFrame([(1, 10, 4.0), (2, 10, 6.0), (3, 11, 8.0)], "seg long, poly long, v double")
    points = spark.createDataFrame([(1, 1.0), (3, 2.0), (4, 3.0), (4, 5.0)], "seg long, v double")
    hit = spark.createDataFrame([(10,), (10,)], "poly long")
    got = {r["seg"]: r["target"] for r in pipelines.prepare_training_dual(segments, polygons, points, "seg", "v", "area", "poly", hit).collect()}
    assert got == {1: 0.5, 3: 4.0, 4: 4.0}, "polygon 10 is hit by a point; polygon 11 wins over the point in segment 3"


def test_kernel_blocks_and_bandwidth(spark, monkeypatch):
    monkeypatch.setattr(models, "BLOCK_ROWS", 7)
    rows = [(i, (i % 13) / 13 + 0.01, (i % 5) / 5 + 0.01, float(i % 13)) for i in range(40)] + [(99, None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id long, FFa double, FFb double, y double")
    known = [r for r in rows if r[1] is not None]
    ma, mb = max(r[1] for r in known), 1.0
    weight = lambda q, t, s: math.exp(-(abs(q[1] - t[1]) / ma + abs(q[2] - t[2]) / mb) / s)
    got = {r["id"]: r["score"] for r in models.apply_general(df.where("FFa is not null"), df, ["FFa", "FFb"], "y", 0.1, "id").collect()}
    for q in known:
        w = [weight(q, t, 0.1) for t in known]
        assert got[q[0]] == pytest.approx(sum(a * t[3] for a, t in zip(w, known, strict=True)) / sum(w))
    error = models.bandwidth_error(df, ["FFa", "FFb"], "y", [0.05, 0.5])
    for s, e in error.items():
        want = []
        for q in known:
            w = [(weight(q, t, s), t[3]) for t in known]
            want.append(abs((sum(a * y for a, y in w) - q[3]) / sum(a for a, _ in w) - q[3]))  # its own weight stays
        assert e == pytest.approx(sum(want) / len(want))
    best = models.bandwidth(df, ["FFa", "FFb"], "y", rounds=3, points=6)
    grid = models.bandwidth_error(df, ["FFa", "FFb"], "y", [best, 0.02, 0.1, 0.3, 0.6, 1.0])
    assert grid[best] <= min(grid.values()) * 1.01
    assert models.bandwidth_error(df.limit(0), ["FFa"], "y", [0.1])


def test_sparse_regression_rules_out_noise(spark):
    rows = [(float(i % 7), float((i * 5) % 11), float((i * 3) % 13), 3.0 * (i % 7) + 1 + ((i * 7919) % 101 - 50) / 500) for i in range(300)]
    df = spark.createDataFrame(rows, "FFa double, FFb double, FFc double, y double")
    m = models.fit_ard(df, ["FFa", "FFb", "FFc"], "y")
    assert m.coef[0] / m.scale[0] == pytest.approx(3.0, abs=0.02) and m.intercept == pytest.approx(1.0, abs=0.1)
    assert abs(m.coef[1]) < 0.05 and abs(m.coef[2]) < 0.05


def test_order_statistics_against_numpy(spark):
    import random

    import numpy as np

    from parcelwise.operators import allocate

    draw = random.Random(4)
    data = {"a": [draw.gauss(0, 1e6) for _ in range(3_000)], "b": [1.5] * 500 + [draw.random() for _ in range(400)], "c": [7.0], "d": [1e-12 * k for k in range(50)] + [1e12]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("a", None)], "g string, v double")
    wanted = (0.5, 0.025, 0.1, 0.975)
    got = allocate.order_statistics(df, "g", "v", wanted)
    for g, vs in data.items():
        for q in wanted:
            assert got[g][q] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-18)
    assert allocate.order_statistics(df.limit(0), "g", "v", wanted) == {}
