"""Registered queries of parcels, their features and training values, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models, parcels, recipes, segments, subdivide, transform
from ..sources import geojson
from . import pipelines
from .queries import _diamonds, query, r, t, xy

_SEGMENTS = """p AS (SELECT c_custkey AS id, c_custkey * 37 % 1000 AS x, c_custkey * 91 % 1000 AS y, CAST(c_nationkey AS VARCHAR) AS code FROM customer WHERE c_nationkey IN (1, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 3)),
b AS (SELECT s_suppkey * 37 % 1000 - 40 AS bx, s_suppkey * 91 % 1000 + 0.25 AS b FROM supplier), e AS (SELECT id, x, y, code, b FROM p JOIN b ON bx < x AND bx + 160 > x + 40 AND b > y AND b < y + 25),
u AS (SELECT id, code, y AS level FROM p UNION ALL SELECT id, code, y + 25 FROM p UNION ALL SELECT id, code, b FROM e), l AS (SELECT id, code, (level - lag(level) OVER (PARTITION BY id ORDER BY level)) * 40 AS area FROM u)"""


@query(f"WITH {_SEGMENTS} SELECT id, code, round(area::DOUBLE, 4) AS area FROM l WHERE area > 100")
def created_segments(spark, d):
    """Customers' boxes of land use whose code begins with 1 or 3, cut by suppliers' barriers that run through them."""
    (x, y), (bx, by) = xy("c_custkey"), xy("s_suppkey")
    use = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("code"), parcels.rectangle(x, y, 40.0, 25.0).alias("rings"))
    pt = lambda dx: F.struct((bx - 40 + dx).cast("double").alias("x"), (by + 0.25).cast("double").alias("y"))
    barriers = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(pt(0), pt(160)).alias("pts"))
    return segments.create_segments(use, barriers, 100.0, ["1", "3"], 100.0).select("id", "code", r("area").alias("area"))


_GROUPS = {"work": ["AUTOMOBILE", "MACHINERY"], "home": ["FURNITURE", "HOUSEHOLD"]}
_FEATURES = """s AS (SELECT s_suppkey AS seg_id, s_suppkey * 37 % 1000 AS x, s_suppkey * 91 % 1000 AS y FROM supplier),
n AS (SELECT n_nationkey % 5 * 200 AS bx, n_nationkey // 5 * 200 AS byy, CAST(n_nationkey % 3 + 1 AS VARCHAR) || CAST(n_nationkey % 2 AS VARCHAR) AS code FROM nation),
o AS (SELECT seg_id, code, greatest(0, least(x + 40, bx + 190) - greatest(x, bx)) * greatest(0, least(y + 25, byy + 190) - greatest(y, byy)) AS piece FROM s, n),
l AS (SELECT seg_id, sum(CASE WHEN code LIKE '1%' THEN piece ELSE 0 END) / sum(piece) AS f1, sum(CASE WHEN code LIKE '2%' THEN piece ELSE 0 END) / sum(piece) AS f2 FROM o WHERE piece > 0 GROUP BY seg_id),
c AS (SELECT c_mktsegment AS g, c_custkey * 53 % 1000 + 0.25 AS cx, c_custkey * 29 % 1000 + 0.5 AS cy FROM customer),
i AS (SELECT seg_id, g FROM s JOIN c ON cx > x AND cx < x + 40 AND cy > y AND cy < y + 25), d AS (SELECT seg_id, g, sqrt(pow(cx - x - 20, 2) + pow(cy - y - 12.5, 2)) AS dist FROM s, c)"""
_IN = {k: ", ".join(f"'{v}'" for v in vs) for k, vs in _GROUPS.items()}


@query(f"""WITH {_FEATURES} SELECT seg_id, round(coalesce(max(f1), 0), 6) AS FFcluf1, round(coalesce(max(f2), 0), 6) AS FFcluf2,
{', '.join(f"round(((SELECT count(*) FROM i WHERE i.seg_id = s.seg_id AND g IN ({v})) / 1000.0)::DOUBLE, 6) AS FFcp{k}" for k, v in _IN.items())},
{', '.join(f"round(coalesce((SELECT sum(exp(-dist * dist / 800)) FROM d WHERE d.seg_id = s.seg_id AND dist <= 100 AND g IN ({v})), 0), 5) AS FFpp{k}" for k, v in _IN.items())} FROM s LEFT JOIN l USING (seg_id) GROUP BY seg_id""")
def segment_features(spark, d):
    """Land use, points of interest inside and around, of suppliers' boxes: several recipes under one id."""
    x, y = xy("s_suppkey")
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    parcel = t(spark, d, "supplier").select(F.col("s_suppkey").alias("seg_id"), F.lit(1000.0).alias("area"), parcels.rectangle(x, y, 40.0, 25.0).alias("rings"), (x + 20).alias("x"), (y + 12.5).alias("y"))
    ua = t(spark, d, "nation").select(n.alias("id"), F.concat((n % 3 + 1).cast("string"), (n % 2).cast("string")).alias("code"), parcels.rectangle((n % 5 * 200).cast("double"), F.floor(n / 5).cast("double") * 200, 190.0, 190.0).alias("rings"))
    poi = t(spark, d, "customer").select(k.alias("id"), F.col("c_mktsegment").alias("subtype"), (k * 53 % 1000 + 0.25).cast("double").alias("x"), (k * 29 % 1000 + 0.5).cast("double").alias("y"))
    config = {"side": 100.0, "landuse": {"codes": ["1", "2"]}, "poi": {"groups": _GROUPS}, "poi_proximity": {"groups": _GROUPS, "sd": 20.0}}
    out = parcels.calculate(parcel, {"ua": ua, "poi": poi}, config)
    return out.select("seg_id", *(r(c, 5 if c.startswith("FFpp") else 6).alias(c) for c in out.columns if c.startswith("FF")))


@query("SELECT l_suppkey AS seg_id, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS FFa, round(sum(coalesce(nullif(l_tax, 0.02), 0) * l_quantity) / sum(l_quantity), 6) AS FFb FROM lineitem GROUP BY l_suppkey")
def point_features_to_segments(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("seg_id"), F.col("l_discount").alias("FFa"), F.nullif("l_tax", F.lit(0.02)).alias("FFb"), F.col("l_quantity").alias("WT_AREA"))
    return recipes.to_segments(rows, ["FFa", "FFb"]).select("seg_id", r("FFa", 6).alias("FFa"), r("FFb", 6).alias("FFb"))


@query("""WITH b AS (SELECT c_custkey, (10 + c_custkey % 50) * (5 + c_custkey % 20) AS area FROM customer) SELECT c_custkey, CAST(pow(2, greatest(0, ceil(log2(area / 130.5)))) AS BIGINT) AS parts, area::DOUBLE AS area FROM b""")
def subdivided_boxes(spark, d):
    k = F.col("c_custkey")
    x, y = xy("c_custkey")
    boxes = t(spark, d, "customer").select(k, F.element_at(parcels.rectangle(x, y, 10 + k % 50, 5 + k % 20), 1).alias("ring"))
    out = subdivide.subdivide(boxes, "c_custkey", "ring", 130.5, 10.0)
    return out.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("parts"), r(F.sum("area")).alias("area"))


@query("SELECT c_custkey, round(coalesce(sum(o_totalprice), -1.0), 2) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def updated_by_key(spark, d):
    spent = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"))
    return geojson.updated(t(spark, d, "customer").select("c_custkey"), spent, "c_custkey", ["spent"], -1.0).select("c_custkey", r("spent", 2).alias("spent"))


@query("""WITH v AS (SELECT o_custkey AS k, sum(o_totalprice) AS total, avg(o_totalprice) AS mean FROM orders GROUP BY 1)
SELECT c_custkey, round(coalesce(total, 0) / (c_custkey % 9 + 1) * 1e6, 1) AS absolute, round(coalesce(mean, 0), 6) AS relative FROM customer LEFT JOIN v ON k = c_custkey""")
def training_values(spark, d):
    seg = t(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 9 + 1).cast("double").alias("area"))
    values = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    a, b = (pipelines.prepare_training(seg, values, "c_custkey", "o_totalprice", "area", flag).select("c_custkey", F.col("target").alias(n)) for flag, n in ((True, "absolute"), (False, "relative")))
    return a.join(b, "c_custkey").select("c_custkey", r("absolute", 1).alias("absolute"), r("relative", 6).alias("relative"))


@query("""WITH g AS (SELECT o_orderkey AS polygon, o_custkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)),
a AS (SELECT k, sum(v) AS t FROM g GROUP BY k), b AS (SELECT o_custkey AS k, sum(o_totalprice) AS t FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT k FROM a) GROUP BY 1)
SELECT c_custkey, round(t / (c_custkey % 9 + 1) * 1e6, 1) AS target FROM customer JOIN (SELECT * FROM a UNION ALL SELECT * FROM b) ON k = c_custkey""")
def dual_training_values(spark, d):
    """Finished orders as polygons, of which those with a large item are hit by a point; open ones as points."""
    seg = t(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 9 + 1).cast("double").alias("area"))
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("polygon"), F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderstatus")
    hit = t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("polygon"))
    out = pipelines.prepare_training_dual(seg, o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "c_custkey", "o_totalprice", "area", "polygon", hit)
    return out.select("c_custkey", r("target", 1).alias("target"))


@query("""WITH m AS (SELECT max(p_retailprice) AS a, max(p_size) AS b FROM part), c AS (SELECT var_samp(p_retailprice / a) AS a, covar_samp(p_retailprice / a, p_size / b) AS b, var_samp(p_size / b) AS c FROM part, m)
SELECT 1 AS k, round((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b), 6) AS variance FROM c UNION ALL SELECT 2, round((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b), 6) FROM c""")
def principal_variances(spark, d):
    rows = t(spark, d, "part").select(F.col("p_retailprice").alias("FFa"), F.col("p_size").cast("double").alias("FFb"))
    values, _ = models.principal(rows, ["FFa", "FFb"])
    return spark.createDataFrame([(i + 1, round(float(v), 6)) for i, v in enumerate(values)], "k int, variance double")



_SPOTS = {"geometry": "Point", "input-geometries": ["polygon", "line"], "selector": {"compound": "or", "clauses": [{"status": ["F", "O"]}, {"nation": True}]}, "attributes": [{"name": "nation", "type": "int", "getter": {"get": "nation"}}]}


@query("""SELECT s_suppkey AS id, 'Polygon' AS kind, CAST(s_nationkey AS BIGINT) AS nation, CAST(s_suppkey * 37 % 1000 AS DOUBLE) AS x, CAST(s_suppkey * 91 % 1000 AS DOUBLE) AS y FROM supplier
UNION ALL SELECT o_orderkey, 'LineString', NULL, CAST(o_orderkey * 37 % 1000 + 5 AS DOUBLE), CAST(o_orderkey * 91 % 1000 AS DOUBLE) FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def geometry_layers(spark, d):
    """A layer of points from polygons and lines; points of several places are routed away."""
    tags = lambda k, c: F.map_filter(F.create_map(F.lit(k), F.col(c).cast("string")), lambda a, b: b.isNotNull())
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    shape = lambda kind, parts: F.struct(F.lit(kind).alias("type"), parts.alias("parts")).alias("geometry")
    areas = _diamonds(spark, d).join(t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").select(F.col("s_suppkey").alias("id"), F.lit("Polygon").alias("kind"), tags("nation", "s_nationkey").alias("tags"), shape("Polygon", F.array("rings")))
    x, y = xy("o_orderkey")
    ways = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("LineString").alias("kind"), tags("status", "o_orderstatus").alias("tags"), shape("LineString", F.array(F.array(F.array(pt(x, y), pt(x + 5, y), pt(x + 5, y + 9))))))
    x, y = xy("c_custkey")
    many = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("MultiPoint").alias("kind"), tags("nation", "c_nationkey").alias("tags"), shape("MultiPoint", F.array(F.array(F.array(pt(x, y))), F.array(F.array(pt(x + 1, y))))))
    out = transform.layer(areas.unionByName(ways).unionByName(many), _SPOTS, geometry_type="kind", geometry="geometry")
    at = F.element_at(F.element_at(F.element_at("geometry.parts", 1), 1), 1)
    return out.select("id", "kind", "nation", r(at["x"]).alias("x"), r(at["y"]).alias("y"))


@query("""WITH c AS (SELECT c_custkey, c_custkey * 53 % 1000 + 0.25 AS x, c_custkey * 29 % 1000 + 0.5 AS y FROM customer), s AS (SELECT s_suppkey, s_suppkey * 37 % 1000 AS px, s_suppkey * 91 % 1000 AS py FROM supplier),
d AS (SELECT c_custkey, s_suppkey, round(sqrt(pow(greatest(px - x, x - px - 40, 0), 2) + pow(greatest(py - y, y - py - 25, 0), 2))::DOUBLE, 9) AS distance FROM c, s)
SELECT c_custkey, s_suppkey, round(distance, 6) AS distance FROM d WHERE distance <= 10 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY distance, s_suppkey) = 1""")
def nearest_parcel(spark, d):
    x, y = xy("s_suppkey")
    k = F.col("c_custkey")
    points = t(spark, d, "customer").select(k, (k * 53 % 1000 + 0.25).cast("double").alias("x"), (k * 29 % 1000 + 0.5).cast("double").alias("y"))
    boxes = t(spark, d, "supplier").select("s_suppkey", parcels.rectangle(x, y, 40.0, 25.0).alias("rings"))
    return parcels.nearest_polygon(points, boxes, "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey", r("distance", 6).alias("distance"))
