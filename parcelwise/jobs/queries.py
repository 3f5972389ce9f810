"""The registered queries on the driver's tables, each with the DuckDB SQL that checks it.

The tables hold no geometry; keys give coordinates: x = key * 37 % 1000, y = key * 91 % 1000,
and ``part`` is a grid of 50 columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import selectors as sel
from ..operators import aggregate, allocate, models, network, raster, spatial, transform
from ..sources import osm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: str | Column, digits: int = 4) -> Column:
    return F.round(c, digits)


def spread(spark: SparkSession, sf_dir: str, name: str):
    """More tasks for what is kept inside, if the table is large."""
    return network.spread(spark, t(spark, sf_dir, name).count())


def xy(key: str) -> tuple[Column, Column]:
    k = F.col(key)
    return (k * 37 % 1000).cast("double"), (k * 91 % 1000).cast("double")


# --- allocation and validation ----------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(o_totalprice * l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 4) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def allocate_orders(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    with spread(spark, d, "lineitem"):
        return network.kept(allocate.allocate(rows, "l_orderkey", "o_totalprice", "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", r("value").alias("value")))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, 100.0 * (s_nationkey + 1) AS main, CASE WHEN s_acctbal - 1000 > 0 THEN (s_acctbal - 1000) * (s_suppkey % 7 + 1) / 1e6 ELSE 0.0 END AS p FROM supplier)
SELECT s_suppkey, round(coalesce(main * p / nullif(sum(p) OVER (PARTITION BY s_nationkey), 0), 0), 4) AS value FROM s""")
def transfer_absolute(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", "s_nationkey", (100.0 * (F.col("s_nationkey") + 1)).alias("main"), (F.col("s_acctbal") - 1000).alias("w"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("area"))
    return allocate.transfer_absolute(s, "s_nationkey", "main", "w", "area").select("s_suppkey", r("value").alias("value"))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, 10.0 * (s_nationkey + 1) AS main, abs(s_acctbal) + 1 AS w, CAST(s_suppkey % 5 + 1 AS DOUBLE) AS a FROM supplier)
SELECT s_suppkey, round(main * w * sum(a) OVER (PARTITION BY s_nationkey) / sum(w * a) OVER (PARTITION BY s_nationkey), 4) AS value FROM s""")
def transfer_relative(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", "s_nationkey", (10.0 * (F.col("s_nationkey") + 1)).alias("main"), (F.abs("s_acctbal") + 1).alias("w"), (F.col("s_suppkey") % 5 + 1).cast("double").alias("a"))
    return allocate.transfer_relative(s, "s_nationkey", "main", "w", "a").select("s_suppkey", r("value").alias("value"))


_MODEL = """m AS (SELECT o_totalprice * l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS model, l_extendedprice AS real FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _modelled(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_extendedprice").join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    return allocate.allocate(rows, "l_orderkey", "o_totalprice", "l_extendedprice", "model").select("model", F.col("l_extendedprice").alias("real"))


@query(f"""WITH {_MODEL}, a AS (SELECT avg(real) AS mean FROM m)
SELECT count(*) AS n, round(sum(model - real), 2) AS mismatch, round(sum(abs(model - real)), 2) AS tae, round(sum(abs(model - real)) / sum(real), 6) AS rtae,
round(sqrt(sum((model - real) * (model - real)) / count(*)), 4) AS rmse, round(1 - sum((model - real) * (model - real)) / sum((real - mean) * (real - mean)), 6) AS r2 FROM m, a""")
def error_measures(spark, d):
    with spread(spark, d, "lineitem"):
        e = allocate.errors(_modelled(spark, d))
    return e.select("n", r("mismatch", 2).alias("mismatch"), r("tae", 2).alias("tae"), r("rtae", 6).alias("rtae"), r("rmse").alias("rmse"), r("r2", 6).alias("r2"))


_Q = ", ".join(f"round(quantile_cont(v, {q}), 3) AS q{str(q * 100).rstrip('0').rstrip('.').replace('.', '_')}" for q in allocate.QUANTILES)


@query(f"""WITH {_MODEL}, u AS (SELECT 'model' AS dataset, model AS v FROM m UNION ALL SELECT 'real', real FROM m UNION ALL SELECT 'residual', model - real FROM m UNION ALL SELECT 'abs_residual', abs(model - real) FROM m)
SELECT dataset, round(sum(v), 2) AS sum, round(min(v), 3) AS min, round(max(v), 3) AS max, round(avg(v), 3) AS mean, round(median(v), 3) AS median, {_Q} FROM u GROUP BY dataset""")
def error_descriptors(spark, d):
    with spread(spark, d, "lineitem"):
        out = allocate.descriptors(_modelled(spark, d))
    return out.select("dataset", r("sum", 2).alias("sum"), *(r(c, 3).alias(c) for c in out.columns if c not in ("dataset", "sum")))


@query("""WITH p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN -1 ELSE s_nationkey END AS k, s_acctbal AS model, CAST(s_nationkey * 10 AS DOUBLE) AS real FROM supplier),
a AS (SELECT k, sum(model) AS model, min(real) AS real FROM p WHERE k <> -1 GROUP BY k), truth AS (SELECT n_nationkey AS k, CAST(n_nationkey * 10 AS DOUBLE) AS real FROM nation)
SELECT k, round(model, 4) AS model, real FROM a UNION ALL SELECT k, round(model, 4), 0.0 FROM p WHERE k = -1
UNION ALL SELECT k, 0.0, real FROM truth WHERE k NOT IN (SELECT k FROM p)""")
def dissolve_and_complete(spark, d):
    p = t(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 9 == 0, -1).otherwise(F.col("s_nationkey")).alias("k"), F.col("s_acctbal").alias("model"), (F.col("s_nationkey") * 10).cast("double").alias("real"))
    truth = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 10).cast("double").alias("real"))
    return allocate.add_unmatched(allocate.dissolve(p, "k", "model", "real"), truth, "k", "real").select("k", r("model").alias("model"), "real")


# --- aggregates and windows -------------------------------------------------------


@query("""SELECT l_suppkey, round(coalesce(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0.0) / (l_suppkey % 4 + 1), 4) AS c_A, round(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0.0) / (l_suppkey % 4 + 1), 4) AS c_R
FROM lineitem GROUP BY l_suppkey""")
def category_sums(spark, d):
    rows = t(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity", (F.col("l_suppkey") % 4 + 1).cast("double").alias("area"))
    out = aggregate.category_sums(rows, "l_suppkey", "l_returnflag", "l_quantity", ["A", "R"], area="area")
    return out.select("l_suppkey", r("c_A").alias("c_A"), r("c_R").alias("c_R"))


@query("""WITH s AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, round(coalesce(a / nullif(a + r, 0), 0), 6) AS f_A, round(coalesce(r / nullif(a + r, 0), 0), 6) AS f_R FROM s""")
def category_fractions(spark, d):
    out = aggregate.category_fractions(t(spark, d, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity", ["A", "R"])
    return out.select("l_suppkey", r("f_A", 6).alias("f_A"), r("f_R", 6).alias("f_R"))


@query("""SELECT o_custkey, """ + ", ".join(f"round(sum(CASE WHEN o_orderpriority LIKE '{p}%' THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 6) AS p_{p}" for p in "123") + " FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_custkey")
def prefix_fractions(spark, d):
    out = aggregate.prefix_fractions(t(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_totalprice", ["1", "2", "3"])
    return out.select("o_custkey", *(r(f"p_{p}", 6).alias(f"p_{p}") for p in "123"))


@query("""SELECT user_id, CAST(coalesce(sum(CASE WHEN event_type IN ('click', 'view') THEN 1 END), 0) AS DOUBLE) AS g_browse, CAST(coalesce(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 END), 0) AS DOUBLE) AS g_act FROM events GROUP BY user_id""")
def merged_categories(spark, d):
    return aggregate.merged_sums(t(spark, d, "events"), "user_id", "event_type", F.lit(1.0), {"browse": ["click", "view"], "act": ["purchase", "signup"]})


@query("""WITH p AS (SELECT l_suppkey, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
c AS (SELECT l_suppkey, v, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY l_suppkey) AS total FROM p),
m AS (SELECT l_suppkey, min(v) AS wmedian FROM c WHERE 2 * run >= total GROUP BY l_suppkey)
SELECT l_suppkey, round(sum(l_extendedprice), 2) AS sum, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(sum(l_extendedprice * l_quantity), 2) AS wsum,
round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS wmean, round(min(wmedian), 4) AS wmedian FROM lineitem JOIN m USING (l_suppkey) GROUP BY l_suppkey""")
def weighted_summaries(spark, d):
    out = aggregate.summaries(t(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity"), "l_suppkey", "l_extendedprice", "l_quantity")
    return out.select("l_suppkey", r("sum", 2).alias("sum"), r("mean").alias("mean"), r("median").alias("median"), r("wsum", 2).alias("wsum"), r("wmean").alias("wmean"), r("wmedian").alias("wmedian"))


@query("""SELECT l_partkey, round(sum(coalesce(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount END, 0) * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY l_partkey""")
def point_means(spark, d):
    rows = t(spark, d, "lineitem").select("l_partkey", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")).alias("v"), "l_quantity")
    return aggregate.point_means(rows, "l_partkey", "v", "l_quantity").select("l_partkey", r("mean", 6).alias("mean"))


def _flows(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = rows.join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return aggregate.flows(rows, "c_nationkey", "s_nationkey", "l_quantity", "l_extendedprice")


_FLOWS = """f AS (SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_quantity) AS q, sum(l_extendedprice) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


@query(f"WITH {_FLOWS} SELECT src, dst, round(q, 2) AS quantity, round(p, 2) AS price FROM f")
def vector_flows(spark, d):
    return _flows(spark, d).select("src", "dst", r("l_quantity", 2).alias("quantity"), r("l_extendedprice", 2).alias("price"))


@query(f"WITH {_FLOWS} SELECT n_nationkey AS zone, round(coalesce((SELECT sum(q) FROM f WHERE src = n_nationkey), 0), 2) AS outflow, round(coalesce((SELECT sum(q) FROM f WHERE dst = n_nationkey), 0), 2) AS inflow FROM nation WHERE n_nationkey IN (SELECT src FROM f UNION SELECT dst FROM f)")
def zone_flows(spark, d):
    return aggregate.zone_totals(_flows(spark, d), "l_quantity").select("zone", r("outflow", 2).alias("outflow"), r("inflow", 2).alias("inflow"))


@query(f"WITH {_FLOWS} SELECT src, round(coalesce(sum(CASE WHEN dst >= 20 THEN q END), 0), 2) AS raw, sum(CASE WHEN dst >= 20 THEN 1 ELSE 0 END) AS failures FROM f GROUP BY src")
def raw_flows(spark, d):
    zones = t(spark, d, "nation").where("n_nationkey < 20").select("n_nationkey")
    return aggregate.raw_flows(_flows(spark, d), zones, "l_quantity").select("src", r("raw", 2).alias("raw"), "failures")


@query(f"""WITH {_FLOWS}, u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, CASE WHEN src <= dst THEN q END AS o, CASE WHEN src >= dst THEN q END AS i FROM f)
SELECT a, b, round(coalesce(sum(o), 0), 2) AS out, round(coalesce(sum(i), 0), 2) AS "in", CAST(count(o) > 0 AS INT) AS has_out, CAST(count(i) > 0 AS INT) AS has_in FROM u GROUP BY a, b""")
def two_sided_flows(spark, d):
    out = aggregate.two_sided(_flows(spark, d), "l_quantity")
    return out.select("a", "b", r("out", 2).alias("out"), r("in", 2).alias("in"), "has_out", "has_in")


@query(f"""WITH {_FLOWS}, h AS (SELECT * FROM f WHERE src < dst)
SELECT a.src, a.dst, round(coalesce(x.q, y.q), 2) AS quantity FROM f a LEFT JOIN h x ON a.src = x.src AND a.dst = x.dst LEFT JOIN h y ON a.src = y.dst AND a.dst = y.src""")
def sideless_flows(spark, d):
    f = _flows(spark, d)
    out = aggregate.sideless(f.select("src", "dst"), "src", "dst", f.where("src < dst").select("src", "dst", "l_quantity"), "l_quantity")
    return out.select("src", "dst", r("l_quantity", 2).alias("quantity"))


_MODE = 5


@query(f"""WITH s AS (SELECT p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
x AS (SELECT p_brand, o, (rn + o) // {_MODE} AS run, avg(v) AS a, (max(v) - min(v)) / count(*) AS width, count(*) AS k FROM s, range({_MODE}) t(o) WHERE n >= {_MODE} GROUP BY 1, 2, 3),
b AS (SELECT p_brand, o, a, row_number() OVER (PARTITION BY p_brand, o ORDER BY width, run) AS rk FROM x WHERE k >= 2)
SELECT p_brand, round(median(a), 4) AS mode FROM b WHERE rk = 1 GROUP BY p_brand UNION ALL SELECT p_brand, round(min(v), 4) FROM s WHERE n < {_MODE} GROUP BY p_brand""")
def general_mode(spark, d):
    return aggregate.general_mode(t(spark, d, "part"), "p_brand", "p_retailprice", _MODE).select("p_brand", r("mode").alias("mode"))


@query()
def natural_breaks(spark, d):
    rows = t(spark, d, "part").select("p_brand", "p_size")
    return aggregate.natural_breaks(rows, "p_brand", "p_size", 4)


# --- configuration-driven layers --------------------------------------------------

LAYERS = {
    "layers": {
        "browse": {
            "selector": {"compound": "and", "clauses": [{"event": ["click", "view"]}, {"compound": "not", "clauses": [{"k": ["7", "13"]}]}, {"k": True}]},
            "attributes": [
                {"name": "kind", "type": "enumstring", "selection": "restrict", "getter": {"more": [{"switch": "event", "cases": {"click": "act", "view": "look"}}, {"ifpresent": "k", "value": "keyed"}]}},
                {"name": "k", "type": "int", "getter": {"get": "k"}},
                {"name": "level", "type": "float", "getter": {"alternative": [{"get": "missing"}, {"constant": 3}]}},
                {"name": "low", "type": "float", "getter": {"min": [{"get": "k"}, {"get": "value"}]}},
                {"name": "any", "type": "string", "getter": {"gather": ["missing", "event"]}},
                {"name": "flag", "type": "boolean", "getter": {"get": "k"}},
            ],
        }
    }
}


@query("""WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, value FROM events), s AS (SELECT * FROM e WHERE event_type IN ('click', 'view') AND k NOT IN ('7', '13') AND k IS NOT NULL)
SELECT event_id, kind, CAST(k AS BIGINT) AS k, 3.0::DOUBLE AS level, round(least(CAST(k AS DOUBLE), value), 4) AS low, event_type AS "any", k <> '' AND k <> '0' AS flag
FROM (SELECT *, CASE event_type WHEN 'click' THEN 'act' ELSE 'look' END AS kind FROM s UNION ALL SELECT *, 'keyed' FROM s)""")
def event_layers(spark, d):
    e = t(spark, d, "events").select("event_id", "event_type", "value", F.get_json_object("props", "$.k").alias("k"))
    tags = F.map_filter(F.create_map(F.lit("event"), F.col("event_type"), F.lit("k"), F.col("k"), F.lit("value"), F.col("value").cast("string")), lambda k, v: v.isNotNull())
    out = transform.layers(e.select("event_id", tags.alias("tags")), LAYERS)["browse"]
    return out.select("event_id", "kind", "k", "level", r("low").alias("low"), "any", "flag")


@query("""SELECT o_orderkey, o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AS urgent, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS level, round(greatest(least(o_totalprice, 200000.0), 50000.0), 2) AS price,
CASE WHEN o_orderpriority LIKE '1%' THEN '1' WHEN o_orderpriority LIKE '2%' THEN '2' END AS first, o_orderstatus IN ('F') AS done FROM orders""")
def lenient_columns(spark, d):
    o = t(spark, d, "orders")
    code = F.col(sel.wildcard(o.columns, "O_ORDERPRIO*"))
    return o.select("o_orderkey", sel.any_prefix(code, ["1", "2"]).alias("urgent"), sel.lenient_int(code.substr(1, 1)).alias("level"), r(sel.clamped(sel.lenient_double(F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))), 50000.0, 200000.0), 2).alias("price"), sel.first_prefix(code, ["1", "2"]).alias("first"), (F.col("o_orderstatus") == "F").alias("done"))


# --- relational assembly: way = order, ord = line number, node = part, relation = customer


def _assembly(spark, d):
    refs = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ord")).agg(F.min("l_partkey").alias("noderef"))
    x, y = xy("p_partkey")
    nodes = t(spark, d, "part").select(F.col("p_partkey").alias("id"), x.alias("lon"), y.alias("lat"))
    ways = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus")).alias("tags"))
    return refs, nodes, ways


@query("""WITH w AS (SELECT l_orderkey AS id, l_linenumber AS ord, min(l_partkey) AS node FROM lineitem GROUP BY 1, 2)
SELECT id, count(*) AS n, string_agg(CAST(node AS VARCHAR), ',' ORDER BY ord) AS refs, CAST(sum(node * 37 % 1000) AS DOUBLE) AS sx, round(coalesce(sum(len), 0), 4) AS length
FROM (SELECT *, sqrt(pow(node * 37 % 1000 - lag(node * 37 % 1000) OVER o, 2) + pow(node * 91 % 1000 - lag(node * 91 % 1000) OVER o, 2)) AS len FROM w WINDOW o AS (PARTITION BY id ORDER BY ord)) GROUP BY id""")
def way_assembly(spark, d):
    refs, nodes, _ = _assembly(spark, d)
    with spread(spark, d, "lineitem"):
        lines = network.kept(osm.way_lines(refs, nodes))
    n = F.size("pts")
    step = F.zip_with(F.slice("pts", F.lit(1), n - 1), F.slice("pts", F.lit(2), n), lambda p, q: F.when(p.isNull() | q.isNull(), 0.0).otherwise(F.hypot(q["x"] - p["x"], q["y"] - p["y"])))
    return lines.select("id", n.cast("long").alias("n"), F.array_join(F.transform("refs", lambda x: x.cast("string")), ",").alias("refs"), F.aggregate("pts", F.lit(0.0), lambda a, p: a + p["x"]).alias("sx"), r(F.aggregate(step, F.lit(0.0), lambda a, b: a + b)).alias("length"))


@query("""WITH e AS (SELECT o_custkey AS id, o_orderkey AS w, 'priority' AS k, o_orderpriority AS v FROM orders UNION ALL SELECT o_custkey, o_orderkey, 'status', o_orderstatus FROM orders),
n AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) SELECT e.id, k, v FROM e JOIN n ON e.id = n.id GROUP BY e.id, k, v, n HAVING count(*) = n""")
def relation_common_tags(spark, d):
    _, _, ways = _assembly(spark, d)
    return osm.common_tags(ways.select(F.col("o_custkey").alias("id"), F.col("id").alias("wayref")), ways.select("id", "tags"))


@query()
def relation_rings(spark, d):
    """Orders as relations: a square's two halves, stitched to one ring; every seventh keeps its way open.
    Even ones have a hole, every third a second square, and every fifth a hole outside of both."""
    rel = F.col("o_orderkey")
    kinds = F.array(F.lit(0), F.lit(1), F.when(rel % 2 == 0, 2), F.when(rel % 3 == 0, 3), F.when(rel % 5 == 0, 4))
    ways = t(spark, d, "orders").select(rel.alias("rel"), F.explode(F.array_compact(kinds)).alias("way"))
    pt = lambda x, y: F.struct((F.col("rel") % 1000 + x).cast("double").alias("x"), (F.col("rel") % 997 + y).cast("double").alias("y"))
    square = lambda x, y, side: [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]
    shapes = [([0, 1, 2], [(0, 0), (9, 0), (9, 9)]), ([0, 3, 2], [(0, 0), (0, 9), (9, 9)]), ([4, 5, 6, 7, 4], square(2, 2, 1)), ([8, 9, 10, 11, 8], square(20, 0, 5)), ([12, 13, 14, 15, 12], square(50, 50, 1))]
    refs, pts = F.lit(None).cast("array<int>"), F.lit(None).cast("array<struct<x: double, y: double>>")
    for i, (nodes, places) in enumerate(shapes):
        refs = F.when(F.col("way") == i, F.array(*map(F.lit, nodes))).otherwise(refs)
        pts = F.when(F.col("way") == i, F.array(*(pt(*p) for p in places))).otherwise(pts)
    broken = (F.col("way") == 1) & (F.col("rel") % 7 == 0)
    lines = ways.select("rel", "way", (F.col("rel") * 8 + F.col("way")).alias("id"), F.when(broken, F.slice(refs, 1, 2)).otherwise(refs).alias("refs"), F.when(broken, F.slice(pts, 1, 2)).otherwise(pts).alias("pts"))
    out = osm.relation_polygons(lines.select(F.col("rel").alias("id"), F.col("id").alias("wayref"), F.col("way").isin(0, 1, 3).alias("outer")), lines)
    first = F.element_at("parts", 1)
    return out.select("id", F.size("parts").alias("n_parts"), F.size(F.element_at(first, 1)).alias("n_points"), (F.size(first) - 1).alias("n_holes"))


SQL["relation_rings"] = "SELECT o_orderkey AS id, 1 + CAST(o_orderkey % 3 = 0 AS INT) AS n_parts, 5 AS n_points, CAST(o_orderkey % 2 = 0 AS INT) + CAST(o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0 AS INT) AS n_holes FROM orders WHERE o_orderkey % 7 <> 0"


# --- geometry ---------------------------------------------------------------------


def _diamonds(spark, d, size=30.0):
    """(s_suppkey, x, y, rings): a diamond around each supplier, with a diamond hole."""
    x, y = xy("s_suppkey")
    s = t(spark, d, "supplier").select("s_suppkey", x.alias("x"), y.alias("y"))

    def ring(a, ccw):
        steps = [(a, 0), (0, a), (-a, 0), (0, -a), (a, 0)]
        return F.array(*(F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i, j in (steps if ccw else steps[::-1])))

    return s.withColumn("rings", F.array(ring(size, True), ring(size / 3, False)))


@query("""SELECT s_suppkey, 1600.0::DOUBLE AS area, round(160 * sqrt(2.0), 4) AS perimeter, round(160 * sqrt(2.0) / (2 * sqrt(pi() * 1600)), 6) AS wagner, true AS outer_ccw, true AS hole_cw, (s_suppkey * 37 % 1000 - 30)::DOUBLE AS xmin, (s_suppkey * 91 % 1000 + 30)::DOUBLE AS ymax FROM supplier""")
def polygon_measures(spark, d):
    p = _diamonds(spark, d)
    parts = F.array("rings")
    area, length = geo.polygon_area(parts), geo.polygon_perimeter(parts)
    outer, hole = F.element_at("rings", 1), F.element_at("rings", 2)
    box = geo.bounds(outer)
    return p.select("s_suppkey", r(area).alias("area"), r(length).alias("perimeter"), r(geo.wagner(length, area), 6).alias("wagner"), (~geo.clockwise(outer)).alias("outer_ccw"), geo.clockwise(hole).alias("hole_cw"), box["xmin"].alias("xmin"), box["ymax"].alias("ymax"))


@query("""WITH c AS (SELECT c_custkey, c_custkey * 53 % 1000 + 0.25 AS x, c_custkey * 29 % 1000 + 0.5 AS y FROM customer), s AS (SELECT s_suppkey, s_suppkey * 37 % 1000 AS px, s_suppkey * 91 % 1000 AS py FROM supplier)
SELECT c_custkey, s_suppkey FROM c, s WHERE abs(x - px) + abs(y - py) < 30 AND abs(x - px) + abs(y - py) > 10""")
def points_in_polygons(spark, d):
    key = F.col("c_custkey")
    points = t(spark, d, "customer").select(key, (key * 53 % 1000 + 0.25).alias("x"), (key * 29 % 1000 + 0.5).alias("y"))
    return spatial.points_in_polygons(points, _diamonds(spark, d).select("s_suppkey", "rings"), "c_custkey", "s_suppkey", 30.0)


_NEAR = """c AS (SELECT c_custkey, c_acctbal, CAST(c_custkey * 37 % 1000 AS DOUBLE) AS x, CAST(c_custkey * 91 % 1000 AS DOUBLE) AS y FROM customer), s AS (SELECT s_suppkey, CAST(s_suppkey * 37 % 1000 AS DOUBLE) AS px, CAST(s_suppkey * 91 % 1000 AS DOUBLE) AS py FROM supplier), d AS (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS dist FROM c, s)"""


def _sides(spark, d):
    (x, y), (px, py) = xy("c_custkey"), xy("s_suppkey")
    return t(spark, d, "customer").select("c_custkey", "c_acctbal", x.alias("x"), y.alias("y")), t(spark, d, "supplier").select("s_suppkey", px.alias("px"), py.alias("py"))


@query(f"WITH {_NEAR}, n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY dist, s_suppkey) AS rk FROM d WHERE dist <= 40) SELECT c_custkey, s_suppkey, round(dist, 6) AS distance FROM n WHERE rk = 1")
def nearest_supplier(spark, d):
    c, s = _sides(spark, d)
    out = spatial.nearest(c, s, 40.0, "c_custkey", "s_suppkey")
    return out.select("c_custkey", "s_suppkey", r("distance", 6).alias("distance"))


@query(f"WITH {_NEAR} SELECT s_suppkey, count(*) AS n, round(sum(c_acctbal * exp(-dist * dist / 800)), 3) AS wsum, round(sum(c_acctbal * exp(-dist * dist / 800)) / sum(exp(-dist * dist / 800)), 4) AS wmean FROM d WHERE dist <= 100 GROUP BY s_suppkey")
def gaussian_neighbourhood(spark, d):
    c, s = _sides(spark, d)
    out = spatial.gaussian_sums(s.withColumnsRenamed({"px": "x", "py": "y"}), c.withColumnsRenamed({"x": "px", "y": "py"}), 20.0, "s_suppkey", "c_acctbal")
    return out.select("s_suppkey", "n", r("wsum", 3).alias("wsum"), r("wmean").alias("wmean"))


@query(f"WITH {_NEAR} SELECT c_custkey, c_custkey IN (SELECT c_custkey FROM d WHERE dist <= 15) AS near FROM customer")
def touching_and_rest(spark, d):
    c, s = _sides(spark, d)
    pairs = spatial.within_range(c, s, 15.0)
    return spatial.touching(c, c, pairs, "c_custkey").select("c_custkey", F.lit(True).alias("near")).unionByName(spatial.touching(c, c, pairs, "c_custkey", anti=True).select("c_custkey", F.lit(False).alias("near")))


_BOX = """a AS (SELECT s_suppkey AS a_id, CAST(s_suppkey * 37 % 1000 AS DOUBLE) AS ax, CAST(s_suppkey * 91 % 1000 AS DOUBLE) AS ay FROM supplier), b AS (SELECT n_nationkey AS b_id, CAST(n_nationkey % 5 * 200 AS DOUBLE) AS bx, CAST(n_nationkey // 5 * 200 AS DOUBLE) AS byy FROM nation),
o AS (SELECT a_id, b_id, greatest(0, least(ax + 40, bx + 190) - greatest(ax, bx)) * greatest(0, least(ay + 25, byy + 190) - greatest(ay, byy)) AS piece FROM a, b)"""


@query(f"WITH {_BOX} SELECT a_id, b_id, round(piece, 4) AS piece_area FROM o WHERE piece > 0 UNION ALL SELECT a_id, -1, round(1000 - sum(piece), 4) FROM o GROUP BY a_id HAVING 1000 - sum(piece) > 1e-9")
def identity_overlay(spark, d):
    def box(x, y, w, h):
        return F.array(F.array(*(F.struct((x + i * w).alias("x"), (y + j * h).alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))))

    x, y = xy("s_suppkey")
    left = t(spark, d, "supplier").select(F.col("s_suppkey").alias("a_id"), box(x, y, 40.0, 25.0).alias("rings"), F.lit(1000.0).alias("area"))
    n = F.col("n_nationkey")
    right = t(spark, d, "nation").select(n.alias("b_id"), box((n % 5 * 200).cast("double"), F.floor(n / 5).cast("double") * 200, 190.0, 190.0).alias("rings"))
    out = spatial.identity(left, spatial.overlay(left, right, "a_id", "b_id", 200.0), "a_id", "b_id", "area")
    return out.select("a_id", "b_id", r("piece_area").alias("piece_area"))


@query("""WITH e AS (SELECT c_custkey, c_custkey * 37 % 1000 AS xmin, c_custkey * 91 % 1000 AS ymin, c_custkey * 37 % 1000 + c_custkey % 9 + 1.5 AS xmax, c_custkey * 91 % 1000 + c_custkey % 7 + 1.5 AS ymax FROM customer), n AS (SELECT *, CAST(greatest(ceil((xmax - xmin) / 2.0), 1) AS BIGINT) AS nx, CAST(greatest(ceil((ymax - ymin) / 2.0), 1) AS BIGINT) AS ny FROM e)
SELECT i, j, round((xmin + i * (xmax - xmin) / nx)::DOUBLE, 4) AS x0, round((ymin + (j + 1) * (ymax - ymin) / ny)::DOUBLE, 4) AS y1 FROM n, LATERAL (SELECT unnest(generate_series(0, nx - 1)) AS i), LATERAL (SELECT unnest(generate_series(0, ny - 1)) AS j)""")
def tile_cover(spark, d):
    x, y = xy("c_custkey")
    k = F.col("c_custkey")
    e = t(spark, d, "customer").select(x.alias("xmin"), y.alias("ymin"), (x + k % 9 + 1.5).alias("xmax"), (y + k % 7 + 1.5).alias("ymax"))
    return spatial.tiles(e, 2.0).select("i", "j", r("x0").alias("x0"), r("y1").alias("y1"))


# --- rasters: part as a grid of 50 columns -----------------------------------------

_CELLS = "g AS (SELECT p_partkey // 50 AS i, p_partkey % 50 AS j, CAST(p_partkey * 7919 % 997 + p_size AS DOUBLE) AS value FROM part)"


def _cells(spark, d):
    k = F.col("p_partkey")
    return t(spark, d, "part").select(F.floor(k / 50).alias("i"), (k % 50).alias("j"), (k * 7919 % 997 + F.col("p_size")).cast("double").alias("value"))


_CROSS = [(0, 0, 2.0), (0, 1, 1.0), (0, -1, 1.0), (1, 0, 1.0), (-1, 0, 1.0)]


@query(f"WITH {_CELLS}, o(di, dj, w) AS (VALUES {', '.join(map(str, _CROSS))}) SELECT a.i, a.j, round(sum(b.value * w) / sum(w), 4) AS value FROM g a, o JOIN g b ON b.i = a.i + di AND b.j = a.j + dj GROUP BY a.i, a.j")
def focal_mean(spark, d):
    return raster.focal_mean(_cells(spark, d), _CROSS).select("i", "j", r("value").alias("value"))


@query(f"WITH {_CELLS}, o(di, dj) AS (SELECT a, b FROM (SELECT unnest(generate_series(-2, 2)) AS a), (SELECT unnest(generate_series(-2, 2)) AS b) WHERE a * a + b * b <= 4) SELECT a.i, a.j, round(median(b.value), 4) AS value FROM g a, o JOIN g b ON b.i = a.i + di AND b.j = a.j + dj GROUP BY a.i, a.j")
def focal_median(spark, d):
    return raster.focal_median(_cells(spark, d), 60.0, 30.0).select("i", "j", r("value").alias("value"))


_HORN = f"""{_CELLS}, w AS (SELECT a.i, a.j, count(*) AS n, sum(b.value * (b.j - a.j) * (2 - abs(b.i - a.i))) / 240.0 AS zx, sum(b.value * (b.i - a.i) * (2 - abs(b.j - a.j))) / 240.0 AS zy FROM g a JOIN g b ON abs(b.i - a.i) <= 1 AND abs(b.j - a.j) <= 1 GROUP BY a.i, a.j),
h AS (SELECT i, j, degrees(atan(sqrt(zx * zx + zy * zy))) AS slope, CASE WHEN zx = 0 AND zy = 0 THEN -1.0 ELSE degrees(atan2(-zx, -zy)) + CASE WHEN atan2(-zx, -zy) < 0 THEN 360 ELSE 0 END END AS aspect FROM w WHERE n = 9)"""


@query(f"WITH {_HORN} SELECT i, j, round(slope, 4) AS slope, round(aspect, 3) AS aspect, round(abs((aspect + 90) % 360 - 180) / 180, 4) AS westness, round(1 - abs(aspect - 180) / 180, 4) AS southness FROM h")
def terrain(spark, d):
    return raster.terrain(_cells(spark, d), 30.0).select("i", "j", r("slope").alias("slope"), r("aspect", 3).alias("aspect"), r("westness").alias("westness"), r("southness").alias("southness"))


@query(f"WITH {_CELLS}, b AS (SELECT quantile_cont(value, [{', '.join(str(k / 20) for k in range(20))}]) AS q FROM g) SELECT i, j, round(len(list_filter(q, lambda x: x < value)) * 5.0::DOUBLE, 4) AS percentile FROM g, b")
def value_percentiles(spark, d):
    return raster.value_percentiles(_cells(spark, d), 20).select("i", "j", r("percentile").alias("percentile"))


_MASK = raster.gaussian_mask(50.0, 50.0, 2.0)


@query(f"WITH {_CELLS}, o(di, dj, w) AS (VALUES {', '.join(f'({a}, {b}, {w!r}::DOUBLE)' for a, b, w in _MASK)}) SELECT g.i - di AS i, g.j - dj AS j, CAST(value AS BIGINT) % 3 AS code, round(sum(w), 6) AS w FROM g, o GROUP BY 1, 2, 3")
def neighbourhood_categories(spark, d):
    cells = _cells(spark, d).select("i", "j", (F.col("value").cast("long") % 3).alias("code"))
    return raster.neighbour_sums(cells, _MASK, "code").select("i", "j", "code", r("w", 6).alias("w"))


@query(f"WITH {_CELLS} SELECT c_custkey, value FROM customer LEFT JOIN g ON i = (c_custkey * 91 % 1000) // 25 AND j = (c_custkey * 37 % 1000) // 20")
def raster_sample(spark, d):
    x, y = xy("c_custkey")
    points = t(spark, d, "customer").select("c_custkey", x.alias("x"), y.alias("y"))
    i, j = raster.cell_of(F.col("x"), F.col("y"), 0, 0, 20.0, 25.0)
    return raster.sample(points, _cells(spark, d), i, j).select("c_custkey", "value")


@query(f"WITH {_CELLS}, m AS (SELECT a.value AS model, b.value AS real FROM g a JOIN g b ON a.i = b.i AND b.j = 49 - a.j WHERE a.value <> 3 AND b.value <> 3) SELECT count(*) AS n, round(sum(model - real), 2) AS mismatch, round(sum(abs(model - real)), 2) AS tae, round(sqrt(avg((model - real) * (model - real))), 4) AS rmse FROM m")
def raster_validation(spark, d):
    g = _cells(spark, d)
    e = allocate.errors(raster.validate(g, g.select("i", (49 - F.col("j")).alias("j"), "value"), 3.0))
    return e.select("n", r("mismatch", 2).alias("mismatch"), r("tae", 2).alias("tae"), r("rmse").alias("rmse"))


# --- networks: customers' nations are joined through orders -------------------------

SPEEDS = {0: {"AUTOMOBILE": 50, "BUILDING": 30, "FURNITURE": 80}, 1: {"AUTOMOBILE": 30, "BUILDING": 20, "MACHINERY": 10}}


@query("""WITH v(f, k, s) AS (VALUES (0, 'AUTOMOBILE', 50.0), (0, 'BUILDING', 30.0), (0, 'FURNITURE', 80.0), (1, 'AUTOMOBILE', 30.0), (1, 'BUILDING', 20.0), (1, 'MACHINERY', 10.0))
SELECT c_custkey, s::DOUBLE AS speed, round((abs(c_acctbal) + 1) / s::DOUBLE * 3.6, 6) AS time FROM customer JOIN v ON c_nationkey % 2 = f AND c_mktsegment = k""")
def edge_times(spark, d):
    e = t(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 2).alias("builtup"), F.col("c_mktsegment").alias("class"), (F.abs("c_acctbal") + 1).alias("length"))
    return network.timed(e, SPEEDS).select("c_custkey", "speed", r("time", 6).alias("time"))


# Vertices are customers and suppliers, joined by what they trade; each nation's first supplier is a target.
_PATHS = """e AS (SELECT o_custkey AS a, 1000000000 + l_suppkey AS b, 1 + min(l_quantity) AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), g AS (SELECT a AS src, b AS dst, cost FROM e UNION ALL SELECT b, a, cost FROM e),
p(target, v, cost) USING KEY (target, v) AS (SELECT 1000000000 + min(s_suppkey), 1000000000 + min(s_suppkey), 0.0::DOUBLE FROM supplier GROUP BY s_nationkey UNION
SELECT p.target, g.src, min(p.cost + g.cost) AS cost FROM p JOIN g ON g.dst = p.v LEFT JOIN recurring.p AS o ON o.target = p.target AND o.v = g.src WHERE o.cost IS NULL OR p.cost + g.cost < o.cost GROUP BY 1, 2)"""


def _graph(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    edges = rows.select(F.col("o_custkey").alias("src"), (F.lit(1_000_000_000) + F.col("l_suppkey")).alias("dst"), (1 + F.col("l_quantity")).alias("cost"))
    return network.directed(edges, F.lit(False))


@query(f"WITH RECURSIVE {_PATHS} SELECT target, v, cost FROM p")
def cheapest_paths(spark, d):
    targets = t(spark, d, "supplier").groupBy("s_nationkey").agg((F.lit(1_000_000_000) + F.min("s_suppkey")).alias("target"))
    with spread(spark, d, "lineitem"):
        return network.cost_matrix(_graph(spark, d), targets)


@query(f"WITH RECURSIVE {_PATHS}, m AS (SELECT v, median(cost) AS m FROM p WHERE v < 1000000000 GROUP BY v) SELECT c_custkey AS v, round(coalesce((SELECT avg(m) FROM m) / nullif(m, 0), 0), 6) AS access FROM customer LEFT JOIN m ON v = c_custkey")
def accessibility(spark, d):
    out = network.accessibility(cheapest_paths(spark, d), t(spark, d, "customer").select(F.col("c_custkey").alias("v")))
    return out.select("v", r("access", 6).alias("access"))


# --- models -----------------------------------------------------------------------


@query("""WITH s AS (SELECT p_partkey, p_retailprice AS y, CAST(p_partkey AS DOUBLE) AS x FROM part) SELECT p_partkey, round(x * (SELECT regr_slope(y, x) FROM s) + (SELECT regr_intercept(y, x) FROM s), 3) AS score FROM s""")
def linear_score(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("double").alias("FFx"), F.lit(0.0).alias("FFzero"), "p_retailprice")
    model = models.fit_ols(rows, models.feature_columns(rows), "p_retailprice")
    return models.apply_linear(rows, model).select("p_partkey", r("score", 3).alias("score"))


@query("""WITH m AS (SELECT max(s_acctbal) AS a, max(s_nationkey) AS b FROM supplier), tr AS (SELECT s_acctbal / a AS x1, s_nationkey / b AS x2, s_suppkey % 10 AS y FROM supplier, m),
q AS (SELECT p_partkey, p_retailprice / a AS x1, p_size / b AS x2 FROM part, m) SELECT p_partkey, round(sum(exp(-(abs(q.x1 - tr.x1) + abs(q.x2 - tr.x2)) / 0.2) * y) / sum(exp(-(abs(q.x1 - tr.x1) + abs(q.x2 - tr.x2)) / 0.2)), 5) AS score FROM q, tr GROUP BY p_partkey""")
def kernel_score(spark, d):
    train = t(spark, d, "supplier").select(F.col("s_acctbal").alias("FFa"), F.col("s_nationkey").cast("double").alias("FFb"), (F.col("s_suppkey") % 10).cast("double").alias("y"))
    rows = t(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("FFa"), F.col("p_size").cast("double").alias("FFb"))
    return models.apply_general(rows, train, ["FFa", "FFb"], "y", 0.2, "p_partkey").select("p_partkey", r("score", 5).alias("score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals allocated to their parts, and the errors of the result: the toolbox in one query."""
    return error_measures(spark, sf_dir)
