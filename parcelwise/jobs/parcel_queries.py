"""Registered queries of parcels with shapes, of features, roads, terrain and rotated models, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import polygon_area
from ..operators import aggregate, layers, models, parcels, planar, recipes, segments, spatial, subdivide
from .queries import _CELLS, _cells, _diamonds, query, r, t, xy


def _pts(*places):
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in places))


@query("""WITH v(kind, area) AS (VALUES (0, 400), (0, 300), (0, 300), (1, 500), (1, 500), (2, 500), (2, 500), (3, 984), (3, 16), (4, 432), (4, 552), (5, 200), (5, 800))
SELECT c_custkey AS id, '11' AS code, area::DOUBLE AS area FROM customer JOIN v ON c_custkey % 6 = kind WHERE c_custkey % 5 <> 0 AND area > 100""")
def parcels_by_barriers(spark, d):
    """Customers' boxes cut by barriers that meet, run through corners or along the border, close up inside, or pass a hole."""
    k = F.col("c_custkey")
    x, y = k % 100 * 100, F.floor(k / 100) * 100
    c, kind = t(spark, d, "customer"), k % 6
    box, hole = parcels.rectangle(x.cast("double"), y.cast("double"), 40.0, 25.0), parcels.rectangle((x + 5).cast("double"), (y + 12).cast("double"), 4.0, 4.0)
    use = c.select(k.alias("id"), F.when(k % 5 == 0, "2").otherwise("11").alias("code"), F.when(kind == 4, F.concat(box, F.transform(hole, F.reverse))).otherwise(box).alias("rings"))
    at = lambda *places: _pts(*((x + i, y + j) for i, j in places))
    paths = {
        0: [at((-1, 10), (41, 10)), at((20, 10), (20, 26))], 1: [at((0, 0), (40, 25))], 2: [at((0, 0), (20, 0), (20, 25))],
        3: [at((10, 5), (14, 5), (14, 9), (10, 9), (10, 5)), at((-1, 20), (30, 20))], 4: [at((-1, 14), (41, 14))], 5: [at((-1, 10), (20, 10)), at((20, 10), (20, -1))],
    }
    every = F.coalesce(*(F.when(kind == n, F.array(*p)) for n, p in paths.items()))
    barriers = c.select(k, F.posexplode(every).alias("n", "pts")).select((k * 2 + F.col("n")).alias("id"), "pts")
    return segments.create_segments(use, barriers, 50.0, ["1"], 100.0).select("id", "code", r("area").alias("area"))


@query("""SELECT c_custkey, round((900 - CASE WHEN c_custkey % 2 = 0 THEN 400 ELSE 16 END)::DOUBLE, 4) AS area, true AS under FROM customer""")
def subdivided_shapes(spark, d):
    """L-shaped polygons, and squares with a hole, in parts under 90 square metres."""
    k = F.col("c_custkey")
    x, y = xy("c_custkey")
    at = lambda *places: _pts(*((x + i, y + j) for i, j in places))
    ell = F.array(at((0, 0), (30, 0), (30, 10), (10, 10), (10, 30), (0, 30), (0, 0)))
    ring = F.array(at((0, 0), (30, 0), (30, 30), (0, 30), (0, 0)), at((4, 4), (4, 8), (8, 8), (8, 4), (4, 4)))
    out = subdivide.subdivide(t(spark, d, "customer").select(k, F.when(k % 2 == 0, ell).otherwise(ring).alias("rings")), "c_custkey", "rings", 90.0, 5.0)
    own = polygon_area(F.array("rings"))
    return out.groupBy("c_custkey").agg(r(F.sum(own)).alias("area"), F.bool_and((own < 90) & (F.abs(own - F.col("area")) < 1e-6)).alias("under"))


_NATIONS = "n AS (SELECT n_nationkey AS k, n_nationkey % 5 * 200 AS bx, n_nationkey // 5 * 200 AS byy FROM nation)"
_SUPPLIERS = "s AS (SELECT s_suppkey, s_suppkey * 37 % 1000 AS x, s_suppkey * 91 % 1000 AS y, s_suppkey % 7 AS w FROM supplier)"


def _nations(spark, d, side):
    n = F.col("n_nationkey")
    return t(spark, d, "nation").select(n.alias("id"), parcels.rectangle((n % 5 * 200).cast("double"), F.floor(n / 5).cast("double") * 200, side, side).alias("rings"))


@query(f"""WITH {_NATIONS}, {_SUPPLIERS}, o AS (SELECT s_suppkey, k, greatest(0, least(x + 40, bx + 190) - greatest(x, bx)) * greatest(0, least(y + 25, byy + 190) - greatest(y, byy)) AS area FROM s, n)
SELECT s_suppkey, k AS id, area::DOUBLE AS area, 4 AS corners FROM o WHERE area > 0""")
def clipped_shapes(spark, d):
    """The pieces of suppliers' boxes in nations' squares, by their own rings."""
    x, y = xy("s_suppkey")
    boxes = t(spark, d, "supplier").select("s_suppkey", parcels.rectangle(x, y, 40.0, 25.0).alias("rings"))
    out = parcels.clipped_polygons(boxes, _nations(spark, d, 190.0), "s_suppkey", "id", 100.0)
    return out.select("s_suppkey", "id", r(polygon_area(F.array("rings"))).alias("area"), F.size(F.element_at("rings", 1)).alias("corners"))


@query(f"""WITH {_NATIONS}, {_SUPPLIERS}, o AS (SELECT s_suppkey, greatest(0, least(x + 60, bx + 100) - greatest(x, bx)) AS len FROM s, n WHERE y + 0.1 > byy AND y + 0.1 < byy + 100)
SELECT s_suppkey, count(*) AS pieces, round(sum(len)::DOUBLE, 4) AS length FROM o WHERE len > 0 GROUP BY s_suppkey""")
def clipped_paths(spark, d):
    """Suppliers' lines cut to nations' squares."""
    x, y = xy("s_suppkey")
    paths = t(spark, d, "supplier").select("s_suppkey", _pts((x, y + 0.1), (x + 25, y + 0.1), (x + 60, y + 0.1)).alias("pts"))
    out = parcels.clipped_lines(paths, _nations(spark, d, 100.0), "s_suppkey", "id", 100.0)
    return out.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("pieces"), r(F.sum(F.element_at("pts", -1)["x"] - F.element_at("pts", 1)["x"])).alias("length"))


@query(f"""WITH {_NATIONS}, {_SUPPLIERS}, o AS (SELECT s_suppkey, x, bx, greatest(byy - y - 0.1, y + 0.1 - byy - 100, 0) AS dy FROM s, n),
h AS (SELECT s_suppkey, greatest(0, least(x + 60, bx + 100 + sqrt(400 - dy * dy)) - greatest(x, bx - sqrt(400 - dy * dy))) AS len FROM o WHERE dy <= 20)
SELECT s_suppkey, round((60 - coalesce(sum(len), 0))::DOUBLE, 4) AS rural, round(coalesce(sum(len), 0)::DOUBLE, 4) AS builtup FROM s LEFT JOIN h USING (s_suppkey) GROUP BY s_suppkey""")
def roads_by_built_up(spark, d):
    """How much of suppliers' roads lies within 20 m of nations' squares."""
    x, y = xy("s_suppkey")
    roads = t(spark, d, "supplier").select("s_suppkey", x.alias("x1"), (y + 0.1).alias("y1"), (x + 60).alias("x2"), (y + 0.1).alias("y2"))
    bits = parcels.split_built_up(roads, _nations(spark, d, 100.0), "s_suppkey", "id", 20.0)
    on = lambda flag: r(F.sum(F.when(F.col("builtup") == flag, F.col("x2") - F.col("x1")).otherwise(0.0)))
    return bits.groupBy("s_suppkey").agg(on(0).alias("rural"), on(1).alias("builtup"))


@query(f"""WITH {_NATIONS}, {_SUPPLIERS}, o AS (SELECT k, 1000.0 + s_suppkey % 50 AS size, 1 + w / 10.0 AS shape, greatest(0, least(x + 40, bx + 190) - greatest(x, bx)) * greatest(0, least(y + 25, byy + 190) - greatest(y, byy)) AS a FROM s, n),
p AS (SELECT * FROM o WHERE a > 0), q AS (SELECT k, shape, sum(a) AS a FROM p GROUP BY 1, 2), c AS (SELECT k, shape, sum(a) OVER (PARTITION BY k ORDER BY shape) AS run, sum(a) OVER (PARTITION BY k) AS total FROM q),
m AS (SELECT k, min(shape) AS wmedian FROM c WHERE 2 * run >= total GROUP BY k)
SELECT k AS seg_id, round(sum(size)::DOUBLE, 4) AS FFcbsize_sum, round(avg(size)::DOUBLE, 4) AS FFcbsize_mean, round(median(size)::DOUBLE, 4) AS FFcbsize_median, round(avg(shape)::DOUBLE, 4) AS FFcbwag_mean, round(median(shape)::DOUBLE, 4) AS FFcbwag_median,
round((sum(shape * a) / sum(a))::DOUBLE, 4) AS FFcbwag_wmean, round(min(wmedian)::DOUBLE, 4) AS FFcbwag_wmedian FROM p JOIN m USING (k) GROUP BY k""")
def building_features(spark, d):
    """Size and shape of suppliers' buildings in nations' squares, weighted by the pieces inside."""
    x, y = xy("s_suppkey")
    k = F.col("s_suppkey")
    buildings = t(spark, d, "supplier").select(k.alias("building"), (1000.0 + k % 50).alias("AREA"), (1 + k % 7 / 10).alias("WAG"), parcels.rectangle(x, y, 40.0, 25.0).alias("rings"))
    pieces = spatial.overlay(_nations(spark, d, 190.0).withColumnRenamed("id", "seg_id"), buildings, "seg_id", "building", 100.0)
    pieces = pieces.withColumn("piece_area", r("piece_area", 6)).join(buildings.select("building", "AREA", "WAG"), "building")
    out = recipes.buildings(pieces)
    return out.select(F.col("seg_id").cast("long").alias("seg_id"), *(r(c).alias(c) for c in out.columns if c != "seg_id"))


@query("""WITH c AS (SELECT c_custkey, c_custkey * 53 % 1000 + 0.25 AS x, c_custkey * 29 % 1000 + 0.5 AS y FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)), s AS (SELECT s_suppkey, s_suppkey * 37 % 1000 AS px, s_suppkey * 91 % 1000 AS py FROM supplier)
SELECT c_custkey, s_suppkey FROM c, s WHERE abs(x - px) + abs(y - py) < 30 AND abs(x - px) + abs(y - py) > 10""")
def repeated_points_in_polygons(spark, d):
    """A point for each order, at its customer, in polygons that stand in their table twice."""
    key = F.col("o_custkey")
    points = t(spark, d, "orders").select(key.alias("c_custkey"), (key * 53 % 1000 + 0.25).alias("x"), (key * 29 % 1000 + 0.5).alias("y"))
    shapes = _diamonds(spark, d).select("s_suppkey", "rings")
    return spatial.points_in_polygons(points, shapes.union(shapes), "c_custkey", "s_suppkey", 30.0)


@query("SELECT s_suppkey, 1 AS crossings FROM supplier WHERE s_suppkey % 3 = 0")
def crossed_rings(spark, d):
    """Rings that cross themselves."""
    x, y = xy("s_suppkey")
    at = lambda *places: F.array(_pts(*((x + i, y + j) for i, j in places)))
    shapes = t(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, at((0, 0), (10, 10), (10, 0), (0, 10), (0, 0))).otherwise(at((0, 0), (10, 0), (10, 10), (0, 10))).alias("rings"))
    return planar.self_intersections(shapes, "s_suppkey", 50.0).select("s_suppkey", F.col("crossings").cast("int").alias("crossings"))


_SMOOTH = f"""{_CELLS.replace("g AS", "raw AS")}, o(di, dj) AS (SELECT a, b FROM (SELECT unnest(generate_series(-2, 2)) AS a), (SELECT unnest(generate_series(-2, 2)) AS b) WHERE a * a + b * b <= 4),
g AS (SELECT a.i, a.j, median(b.value) AS value FROM raw a, o JOIN raw b ON b.i = a.i + di AND b.j = a.j + dj GROUP BY a.i, a.j)"""


@query(f"""WITH {_SMOOTH}, w AS (SELECT a.i, a.j, count(*) AS n, sum(b.value * (b.j - a.j) * (2 - abs(b.i - a.i))) / 240.0 AS zx, sum(b.value * (b.i - a.i) * (2 - abs(b.j - a.j))) / 240.0 AS zy FROM g a JOIN g b ON abs(b.i - a.i) <= 1 AND abs(b.j - a.j) <= 1 GROUP BY a.i, a.j),
h AS (SELECT i, j, degrees(atan(sqrt(zx * zx + zy * zy))) AS slope, CASE WHEN zx = 0 AND zy = 0 THEN -1.0 ELSE degrees(atan2(-zx, -zy)) + CASE WHEN atan2(-zx, -zy) < 0 THEN 360 ELSE 0 END END AS aspect FROM w WHERE n = 9),
b AS (SELECT quantile_cont(value, [{", ".join(str(k / 1000) for k in range(1000))}]) AS q FROM g)
SELECT g.i, g.j, round(len(list_filter(q, lambda x: x < value)) / 10.0::DOUBLE, 4) AS FFhperc, round(slope, 4) AS FFslope, round(abs((aspect + 90) % 360 - 180) / 180, 4) AS FFwest, round(1 - abs(aspect - 180) / 180, 4) AS FFsouth FROM g LEFT JOIN h USING (i, j), b""")
def terrain_features(spark, d):
    """Slope, aspect and height percentiles of the parts' grid, smoothed by a median."""
    out = recipes.terrain(_cells(spark, d), 30.0, 60.0)
    return out.select("i", "j", *(r(c).alias(c) for c in ("FFhperc", "FFslope", "FFwest", "FFsouth")))


_SOFT = recipes.raster.gaussian_mask(20.0, 50.0)


@query(f"""WITH {_CELLS}, o(di, dj, w) AS (VALUES {", ".join(f"({a}, {b}, {w!r}::DOUBLE)" for a, b, w in _SOFT)}), s AS (SELECT g.i - di AS i, g.j - dj AS j, CAST(CAST(value AS BIGINT) % 3 AS VARCHAR) AS code, sum(w) AS w FROM g, o GROUP BY 1, 2, 3)
SELECT i, j, round(sum(CASE WHEN code = '0' THEN w ELSE 0 END) / sum(w), 6) AS FFpluf0, round(sum(CASE WHEN code = '2' THEN w ELSE 0 END) / sum(w), 6) AS FFpluf2 FROM s GROUP BY i, j""")
def land_use_around(spark, d):
    """Gaussian shares of land-use codes around the cells of the parts' grid."""
    cells = _cells(spark, d).select("i", "j", (F.col("value").cast("long") % 3).cast("string").alias("code"))
    out = recipes.neighbourhood_land_use(cells, ["0", "2"], 20.0, 50.0)
    return out.select("i", "j", r("FFpluf0", 6).alias("FFpluf0"), r("FFpluf2", 6).alias("FFpluf2"))


@query("""WITH m AS (SELECT avg(p_partkey) AS a, avg(p_size) AS b, avg(p_retailprice) AS c FROM part), s AS (SELECT sum(pow(p_partkey - a, 2)) AS aa, sum((p_partkey - a) * (p_size - b)) AS ab, sum(pow(p_size - b, 2)) AS bb,
sum((p_partkey - a) * (p_retailprice - c)) AS ay, sum((p_size - b) * (p_retailprice - c)) AS byy FROM part, m), f AS (SELECT (ay * bb - byy * ab) / (aa * bb - ab * ab) AS u, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS v FROM s)
SELECT p_partkey, round(c + u * (p_partkey - a) + v * (p_size - b), 3) AS score FROM part, m, f""")
def rotated_score(spark, d):
    """Least squares on the principal components of two weighted features."""
    rows = t(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("double").alias("FFa"), F.col("p_size").cast("double").alias("FFb"), F.lit(0.0).alias("FFzero"), "p_retailprice")
    model = models.fit_ols(rows, models.feature_columns(rows), "p_retailprice", weights={"FFb": 3.0}, pca=True)
    return models.apply_linear(rows, model).select("p_partkey", r("score", 3).alias("score"))


@query("""SELECT l_suppkey, round(coalesce(sum(CASE WHEN l_returnflag IN ('A', 'R') THEN l_quantity END), 0.0), 2) AS g_back, round(coalesce(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0.0), 2) AS c_A FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_suppkey""")
def commonly_filtered(spark, d):
    """Two aggregators whose categories agree, so that one filter serves both before the shuffle."""
    rows = aggregate.filtered(t(spark, d, "lineitem"), "l_returnflag", [["A", "R"], ["R", "A"]])
    a = aggregate.merged_sums(rows, "l_suppkey", "l_returnflag", F.col("l_quantity"), {"back": ["A", "R"]})
    b = aggregate.category_sums(rows, "l_suppkey", "l_returnflag", "l_quantity", ["A"])
    return a.join(b, "l_suppkey").select("l_suppkey", r("g_back", 2).alias("g_back"), r("c_A", 2).alias("c_A"))


@query("SELECT s_nationkey % 2 AS class, count(*) AS lines, 4 AS corners, 15.0::DOUBLE AS length FROM supplier GROUP BY 1")
def dissolved_roads(spark, d):
    """Suppliers' roads of three edges, stored in both directions, as single lines; others of another class meet them in the middle."""
    k = F.col("s_suppkey")
    x, y = (k % 100 * 100).cast("double"), (F.floor(k / 100) * 100).cast("double")
    steps = [(0, 0, 5, 0), (5, 5, 5, 0), (5, 5, 10, 5), (10, 5, 5, 5)]
    edge = F.explode(F.array(*(F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(s, ("a", "b", "c", "d"), strict=True))) for s in steps)))
    rows = t(spark, d, "supplier").select((F.col("s_nationkey") % 2).alias("class"), x.alias("x"), y.alias("y"), edge.alias("e"))
    edges = rows.select("class", (F.col("x") + F.col("e.a")).alias("x1"), (F.col("y") + F.col("e.b")).alias("y1"), (F.col("x") + F.col("e.c")).alias("x2"), (F.col("y") + F.col("e.d")).alias("y2"))
    crossing = rows.select((F.lit(3) - F.col("class")).alias("class"), (F.col("x") + 5).alias("x1"), F.col("y").alias("y1"), (F.col("x") + 5).alias("x2"), (F.col("y") - 9).alias("y2"))
    out = layers.dissolved(edges.unionByName(crossing), ["class"]).where("class < 2")
    return out.groupBy("class", F.size("pts").alias("corners"), r("length").alias("length")).agg(F.count(F.lit(1)).alias("lines"))
