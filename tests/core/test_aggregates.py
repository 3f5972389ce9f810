"""Expected values come from hand-worked small tables."""

import pytest
from pyspark.sql import functions as F

from parcelwise.operators import aggregate, allocate, models, network, raster


def test_weighted_summaries(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0), (1, 20.0, 1.0), (1, 30.0, 3.0)], "id int, v double, w double")
    r = aggregate.summaries(df, "id", "v", "w").first()
    assert (r["wsum"], r["wmean"], r["wmedian"], r["median"]) == (120.0, 24.0, 30.0, 20.0)


@pytest.mark.parametrize(("q", "want"), [(5, 5.8), (6, 4.25), (7, 4.142857), (8, 3.988095)])
def test_general_mode(spark, q, want):
    # The demonstration series that the expected results belong to.
    values = [1, 2, 4, 5, 5, 6, 6, 7, 8, 9, 11, 13, 16, 20, 24, 30, 45, 80]
    df = spark.createDataFrame([(1, float(v)) for v in values], "id int, v double")
    assert aggregate.general_mode(df, "id", "v", q).first()["mode"] == pytest.approx(want, abs=1e-6)


def test_natural_breaks(spark):
    values = [1, 2, 4, 5, 5, 6, 6, 7, 8, 9, 11, 13, 16, 20, 24, 30, 45, 80]
    df = spark.createDataFrame([(1, float(v)) for v in values], "id int, v double")
    got = [r["upper"] for r in aggregate.natural_breaks(df, "id", "v", 4).orderBy("break_no").collect()]
    assert got == [13.0, 30.0, 45.0, 80.0]


def test_prefix_fractions(spark):
    df = spark.createDataFrame([(1, "1121", 2.0), (1, "1122", 1.0), (1, "999", 1.0), (1, None, 9.0)], "id int, code string, w double")
    r = aggregate.prefix_fractions(df, "id", "code", "w", ["1121", "1122"]).first()
    assert (r["p_1121"], r["p_1122"]) == (0.5, 0.25)


def test_point_means(spark):
    df = spark.createDataFrame([(1, 4.0, 1.0), (1, None, 3.0)], "id int, v double, w double")
    assert aggregate.point_means(df, "id", "v", "w").first()["mean"] == 1.0


def test_transfers_conserve(spark):
    df = spark.createDataFrame([(1, 100.0, -2.0, 5.0), (1, 100.0, 0.0, 5.0), (1, 100.0, 4.0, 5.0), (2, 9.0, 0.0, 1.0)], "g int, main double, w double, area double")
    got = sorted(r["value"] for r in allocate.transfer_absolute(df, "g", "main", "w", "area").collect())
    assert got == [0.0, 0.0, 0.0, 100.0]
    rel = spark.createDataFrame([(1, 10.0, 1.0), (1, 10.0, 3.0)], "g int, main double, w double")
    got = sorted(r["value"] for r in allocate.transfer_relative(rel, "g", "main", "w").collect())
    assert got == [5.0, 15.0]
    assert allocate.allocate(df.where("g = 2"), "g", "main", "w").first()["value"] is None


def test_errors(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 5.0)], "model double, real double")
    r = allocate.errors(df).first()
    assert (r["mismatch"], r["tae"], r["rtae"]) == (-2.0, 2.0, 0.25)
    assert r["rmse"] == pytest.approx(1.154701, abs=1e-6) and r["r2"] == pytest.approx(0.538462, abs=1e-6)


def test_access(spark):
    costs = spark.createDataFrame([(0, 1, 10.0), (0, 2, 20.0), (0, 3, 30.0)], "target int, v int, cost double")
    origins = spark.createDataFrame([(1,), (2,), (3,), (9,)], "v int")
    got = {r["v"]: r["access"] for r in network.accessibility(costs, origins).collect()}
    assert got[1] == 2.0 and got[2] == 1.0 and got[3] == pytest.approx(2 / 3) and got[9] == 0.0


def test_flat_ground(spark):
    cells = spark.createDataFrame([(i, j, 7.0) for i in range(3) for j in range(3)], "i long, j long, value double")
    r = raster.terrain(cells, 10.0).first()
    assert r["slope"] == 0.0 and r["aspect"] == -1.0
    assert r["westness"] == pytest.approx(0.505556, abs=1e-6) and r["southness"] == pytest.approx(-0.005556, abs=1e-6)


def test_models_agree(spark):
    rows = [(float(x) / 5, (x / 5) ** 2, (x / 5) ** 3, 2 * x / 5 + 0.5 * (x / 5) ** 3 + 1, 0.0) for x in range(50)]
    df = spark.createDataFrame(rows, "FFa double, FFb double, FFc double, y double, FFz double")
    names = models.feature_columns(df)
    m = models.fit_ols(df, names, "y")
    assert m.excluded == ["FFz"]
    scored = models.apply_linear(df, m)
    assert scored.agg(F.max(F.abs(F.col("score") - F.col("y")))).first()[0] < 1e-6
    back = models.Model.read(m.frame(spark))
    assert back == m
    ard = models.fit_ard(df, names, "y")
    assert models.apply_linear(df, ard).agg(F.max(F.abs(F.col("score") - F.col("y")))).first()[0] < 0.5
    values, rotation = models.principal(df, ["FFa", "FFb", "FFc"], 0.99)
    assert values[0] >= values[-1] and rotation.shape[0] == 3
    with pytest.raises(KeyError):
        models.apply_linear(df.drop("FFa"), m)
