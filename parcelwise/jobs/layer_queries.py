"""Registered queries of layer upkeep, of parcels against polygons, and of bandwidths, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layers, models, parcels
from .queries import _BOX, _NEAR, _sides, query, r, t, xy


@query("""SELECT o_orderkey, o_orderstatus AS status, coalesce(o_totalprice > 200000, false) AS large, o_orderkey % 7 AS lot, CAST(NULL AS BIGINT) AS mark FROM orders""")
def layer_upkeep(spark, d):
    flagged = layers.flagged(t(spark, d, "orders"), F.col("o_totalprice") > 200000, "large")
    mapped = layers.mapped(flagged, lambda k: k % 7, ["o_orderkey"], "lot")
    return layers.reshaped(mapped, ["o_orderkey", "large"], {"status": "o_orderstatus"}, {"lot": F.col("lot")}, {"mark": "bigint"})


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice > 200000, false)")
def inverse_query(spark, d):
    return layers.rejected(t(spark, d, "orders"), F.col("o_totalprice") > 200000).select("o_orderkey")


@query("""WITH p AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT a AS zone, b AS neighbour FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b""")
def neighbour_zones(spark, d):
    trade = t(spark, d, "lineitem").select("l_suppkey", "l_orderkey").join(t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    buyers = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return layers.neighbours(trade.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")), "s_nationkey", "c_nationkey")


@query("SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY o_custkey")
def last_values(spark, d):
    return layers.last_values(t(spark, d, "orders"), ["o_custkey"], "o_totalprice", ["o_orderdate", "o_orderkey"])


@query("""WITH s AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_partkey, round(v, 4) AS l_quantity FROM s QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY v DESC, l_partkey) = 1""")
def largest_keys(spark, d):
    return layers.top_key(t(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity").select("l_suppkey", "l_partkey", r("l_quantity").alias("l_quantity"))


@query("SELECT DISTINCT o_orderpriority AS class, o_orderstatus AS level, least(o_custkey % 100, o_orderkey % 100) AS a, greatest(o_custkey % 100, o_orderkey % 100) AS b FROM orders")
def homogenised_edges(spark, d):
    e = t(spark, d, "orders").select(F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("level"), (F.col("o_custkey") % 100).alias("a"), (F.col("o_orderkey") % 100).alias("b"))
    return layers.homogenised(e, ["class", "level"], ("a", "b"))


def _boxes(spark, d):
    x, y = xy("s_suppkey")
    n = F.col("n_nationkey")
    left = t(spark, d, "supplier").select(F.col("s_suppkey").alias("a_id"), parcels.rectangle(x, y, 40.0, 25.0).alias("rings"), F.col("s_acctbal").alias("weight"))
    right = t(spark, d, "nation").select(n.alias("b_id"), parcels.rectangle((n % 5 * 200).cast("double"), F.floor(n / 5).cast("double") * 200, 190.0, 190.0).alias("rings"), (n * 10).alias("people"))
    return left, right


@query(f"WITH {_BOX} SELECT a_id, b_id, round(piece, 4) AS piece_area, round(s_acctbal * piece / sum(piece) OVER (PARTITION BY a_id), 4) AS weight, b_id * 10 AS people_MAIN FROM o JOIN supplier ON a_id = s_suppkey WHERE piece > 0")
def assigned_segments(spark, d):
    left, right = _boxes(spark, d)
    return parcels.assigned(left, right, "a_id", "b_id", "weight", "people", 200.0).select("a_id", "b_id", r("piece_area").alias("piece_area"), r("weight").alias("weight"), "people_MAIN")


@query(f"WITH {_BOX} SELECT a_id, round(sum(piece), 4) AS piece_area FROM o WHERE piece > 0 GROUP BY a_id")
def clipped_to_area(spark, d):
    left, right = _boxes(spark, d)
    return parcels.clipped(left, right, "a_id", "b_id", 200.0).select("a_id", r("piece_area").alias("piece_area"))


@query("""WITH a AS (SELECT s_nationkey % 5 AS code, CAST(s_suppkey * 37 % 1000 AS DOUBLE) AS x, CAST(s_suppkey * 91 % 1000 AS DOUBLE) AS y FROM supplier), c AS (SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM range(0, 22) t1(i), range(0, 22) t2(j)),
o AS (SELECT i, j, code, round(sum(greatest(0, least(x + 40, j * 50 + 50) - greatest(x, j * 50)) * greatest(0, least(y + 25, i * 50 + 50) - greatest(y, i * 50))), 9) AS s FROM a, c GROUP BY ALL)
SELECT i, j, code FROM o WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY s DESC, code) = 1""")
def cells_by_largest_code(spark, d):
    x, y = xy("s_suppkey")
    polygons = t(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("code"), parcels.rectangle(x, y, 40.0, 25.0).alias("rings"))
    return parcels.rasterised(polygons, "s_suppkey", "code", 50.0)


@query("""WITH c AS (SELECT c_custkey, c_custkey * 53 % 1000 + 0.25 AS x, c_custkey * 29 % 1000 + 0.5 AS y FROM customer), s AS (SELECT s_suppkey * 37 % 1000 AS px, s_suppkey * 91 % 1000 AS py FROM supplier)
SELECT c_custkey, CAST(max(CASE WHEN pow(greatest(px - x, x - px - 40, 0), 2) + pow(greatest(py - y, y - py - 25, 0), 2) <= 400 THEN 1 ELSE 0 END) AS INT) AS builtup FROM c, s GROUP BY c_custkey""")
def built_up_flags(spark, d):
    x, y = xy("s_suppkey")
    k = F.col("c_custkey")
    points = t(spark, d, "customer").select(k, (k * 53 % 1000 + 0.25).alias("x"), (k * 29 % 1000 + 0.5).alias("y"))
    polygons = t(spark, d, "supplier").select("s_suppkey", parcels.rectangle(x, y, 40.0, 25.0).alias("rings"))
    return parcels.built_up(points, polygons, "c_custkey", "s_suppkey", 20.0)


@query(f"WITH {_NEAR} SELECT s.s_suppkey AS id, round(sum(c_acctbal), 4) AS FFpbsize_sum, round(avg(c_acctbal), 4) AS FFpbsize_mean, round(median(c_acctbal), 4) AS FFpbsize_median, CAST(sum(c_custkey % 9) AS BIGINT) AS FFpbwag_sum, round(avg(c_custkey % 9), 4) AS FFpbwag_mean, round(median(c_custkey % 9), 4) AS FFpbwag_median FROM d s WHERE dist <= 50 GROUP BY s.s_suppkey")
def building_proximity(spark, d):
    c, s = _sides(spark, d)
    buildings = c.select(F.col("c_acctbal").alias("AREA"), (F.col("c_custkey") % 9).alias("WAG"), F.col("x").alias("px"), F.col("y").alias("py"))
    out = parcels.building_proximity(s.select(F.col("s_suppkey").alias("id"), F.col("px").alias("x"), F.col("py").alias("y")), buildings, 10.0)
    return out.select("id", "FFpbwag_sum", *(r(c).alias(c) for c in out.columns if c not in ("id", "FFpbwag_sum")))


@query("""WITH m AS (SELECT max(s_acctbal) AS a, max(s_nationkey) AS b FROM supplier), tr AS (SELECT s_suppkey AS k, s_acctbal / a AS x1, s_nationkey / b AS x2, CAST(s_suppkey % 10 AS DOUBLE) AS y FROM supplier, m), g AS (SELECT unnest([0.05, 0.2, 0.8]::DOUBLE[]) AS sigma),
p AS (SELECT sigma, q.k, any_value(q.y) AS y, sum(exp(-(abs(q.x1 - tr.x1) + abs(q.x2 - tr.x2)) / sigma) * tr.y) AS wy, sum(exp(-(abs(q.x1 - tr.x1) + abs(q.x2 - tr.x2)) / sigma)) AS w FROM tr q, tr, g GROUP BY sigma, q.k)
SELECT sigma, round(avg(abs((wy - y) / w - y)), 5) AS error FROM p GROUP BY sigma""")
def bandwidth_errors(spark, d):
    train = t(spark, d, "supplier").select(F.col("s_acctbal").alias("FFa"), F.col("s_nationkey").cast("double").alias("FFb"), (F.col("s_suppkey") % 10).cast("double").alias("y"))
    found = models.bandwidth_error(train, ["FFa", "FFb"], "y", [0.05, 0.2, 0.8])
    return spark.createDataFrame([(s, round(e, 5)) for s, e in found.items()], "sigma double, error double")
