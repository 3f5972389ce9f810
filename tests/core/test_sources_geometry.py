import json
import math

import pytest
from pyspark.sql import functions as F

from parcelwise.functions import geometry as geo
from parcelwise.functions import selectors as sel
from parcelwise.operators import spatial, transform
from parcelwise.sources import geojson, osm

OSM = """<osm version="0.6">
 <node id="1" lat="0" lon="0"/><node id="2" lat="0" lon="4"/><node id="3" lat="4" lon="4"/><node id="4" lat="4" lon="0"/>
 <node id="5" lat="1" lon="1"><tag k="amenity" v="pub"/><tag k="source" v="x"/></node>
 <node id="6" lat="1" lon="2"/><node id="7" lat="2" lon="1"/>
 <node id="1" lat="0" lon="0"/>
 <way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="landuse" v="grass"/></way>
 <way id="11"><nd ref="1"/><nd ref="4"/><nd ref="3"/><tag k="landuse" v="grass"/><tag k="name" v="b"/></way>
 <way id="12"><nd ref="5"/><nd ref="6"/><nd ref="7"/><nd ref="5"/></way>
 <relation id="20"><member type="way" ref="10" role="outer"/><member type="way" ref="11" role="outer"/>
  <member type="way" ref="12" role="inner"/><tag k="type" v="multipolygon"/></relation>
</osm>"""


def test_osm_to_features(spark, tmp_path):
    (tmp_path / "a.osm").write_text(OSM)
    t = osm.read(spark, str(tmp_path / "a.osm"))
    assert t["nodegeoms"].count() == 7
    p = osm.points(t["nodes"], t["nodegeoms"]).collect()
    assert [(r["id"], dict(r["tags"])) for r in p] == [(5, {"amenity": "pub"})]
    lines = osm.way_lines(t["wayrefs"], t["nodegeoms"])
    ways = {r["id"]: r["kind"] for r in osm.way_features(lines, t["ways"]).collect()}
    assert ways == {10: "LineString", 11: "LineString"}
    tags = osm.relation_tags(t["rels"], osm.common_tags(t["relrefs"], t["ways"])).collect()
    assert [(r["id"], dict(r["tags"])) for r in tags] == [(20, {"landuse": "grass"})]
    parts = osm.relation_polygons(t["relrefs"], lines).first()["parts"]
    assert len(parts) == 1 and [len(r) for r in parts[0]] == [5, 4]
    area = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2
    assert area(parts[0][0]) == 16.0 and area(parts[0][1]) == -0.5


def test_stitching():
    pts = lambda refs: [(r, r) for r in refs]
    ring = osm.stitch([(r, pts(r)) for r in ([1, 2], [3, 2], [3, 4], [1, 4])])
    assert len(ring) == 1 and len(ring[0][0]) == 5
    assert osm.stitch([([1, 2], pts([1, 2])), ([2, 3], pts([2, 3]))]) is None
    assert osm.stitch([([1, 2, 1], pts([1, 2, 1]))]) == []


def test_layer_grammar(spark):
    config = {"layers": {"poi": {"input-geometries": ["point", "polygon"], "selector": {"compound": "or", "clauses": [{"amenity": ["pub", "school"]}, {"shop": True}]}, "attributes": [
        {"name": "subtype", "type": "enumstring", "selection": "restrict", "getter": {"more": [{"switch": "amenity", "cases": {"pub": "restaurant", "school": "school"}}, {"ifpresent": "shop", "value": "convenience"}]}},
        {"name": "height", "type": "float", "getter": {"alternative": [{"get": "height"}, {"constant": 3}]}}]}}}
    rows = [(1, "Point", {"amenity": "pub", "shop": "x", "height": "30 km"}), (2, "LineString", {"amenity": "pub"}), (3, "MultiPolygon", {"shop": "y"}), (4, "Point", {"other": "z"})]
    df = spark.createDataFrame(rows, "id int, kind string, tags map<string,string>")
    got = sorted(tuple(r) for r in transform.layers(df, config, geometry_type="kind")["poi"].select("id", "subtype", "height").collect())
    assert got == [(1, "convenience", 30.0), (1, "restaurant", 30.0), (3, "convenience", 3.0)]


def test_lenient_and_wildcard(spark):
    df = spark.createDataFrame([("1,5", " 7 ", "TRUE"), ("x", "7.5", "0")], "a string, b string, c string")
    got = [tuple(r) for r in df.select(sel.lenient_double(F.col("a")), sel.lenient_int(F.col("b")), sel.lenient_bool(F.col("c"))).collect()]
    assert got[0] == (1.5, 7, True) and got[1][0] is None and got[1][2] is False
    assert sel.wildcard(["id", "code_int", "Code_12"], "CODE*") == "Code_12"
    with pytest.raises(KeyError):
        sel.wildcard(["id"], "CODE*")


def test_polygon_measures(spark):
    outer = [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (1.0, 2.0), (2.0, 1.0), (1.0, 1.0)]
    df = spark.createDataFrame([([[outer, hole]],)], "parts array<array<array<struct<x:double,y:double>>>>")
    a, p = geo.polygon_area(F.col("parts")), geo.polygon_perimeter(F.col("parts"))
    r = df.select(a.alias("a"), p.alias("p"), geo.wagner(p, a).alias("w")).first()
    assert r["a"] == 24.5 and r["p"] == pytest.approx(23.414214, abs=1e-6) and r["w"] == pytest.approx(1.334417, abs=1e-6)


def test_projection(spark):
    x, y = geo.transverse_mercator(F.lit(15.0), F.lit(50.0), 15.0)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r["x"] == pytest.approx(500000.0, abs=1e-3) and r["y"] == pytest.approx(5538630.703, abs=0.5)


def test_overlay_conserves_area(spark):
    ell = [[(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0)]]
    square = [[(0.5, 0.5), (3, 0.5), (3, 3), (0.5, 3), (0.5, 0.5)]]
    to = lambda rings: [[(float(a), float(b)) for a, b in r] for r in rings]
    kind = "id int, rings array<array<struct<x:double,y:double>>>, area double"
    left, right = spark.createDataFrame([(1, to(ell), 7.0)], kind), spark.createDataFrame([(8, to(square), 6.25)], "o int, rings array<array<struct<x:double,y:double>>>, area double")
    pieces = spatial.identity(left, spatial.overlay(left, right, "id", "o", 2.0), "id", "o", "area").collect()
    got = {r["o"]: r["piece_area"] for r in pieces}
    assert got[8] == pytest.approx(0.5 * 2.5 + 0.5 * 2.0) and sum(got.values()) == pytest.approx(7.0)


def test_hull(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x in range(5) for y in range(5)], "x double, y double").repartition(3)
    got = [(r["x"], r["y"]) for r in spatial.hull(df).orderBy("ord").collect()]
    assert got == [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]


def test_geojson_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("Point", [1.5, 2.0], "a", None), ("Point", [3.0, 4.0], "b", 7)], "kind string, c array<double>, name string, n int")
    lines = geojson.lines_of(df, F.col("kind"), F.col("c"), ["name", "n"])
    assert json.loads(lines.first()["value"]) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.0]}, "properties": {"name": "a", "n": None}}
    geojson.write(lines, str(tmp_path / "out"), 1)
    back = geojson.read(spark, str(tmp_path / "out"), lines=True)
    assert sorted((r["kind"], json.loads(r["coordinates"]), r["properties"]["name"]) for r in back.collect()) == [("Point", [1.5, 2.0], "a"), ("Point", [3.0, 4.0], "b")]
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": [json.loads(r["value"]) for r in lines.collect()]}))
    assert geojson.read(spark, str(tmp_path / "c.json")).count() == 2


def test_updates(spark):
    df, v = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 5.0)], "id int, a double")
    assert sorted((r["id"], r["a"]) for r in geojson.updated(df, v, "id", ["a"], 0.0).collect()) == [(1, 5.0), (2, 0.0)]
    with pytest.raises(Exception):
        geojson.updated(df, v, "id", ["a"], strict=True).collect()
    assert geojson.merged([{"a": df}, {"a": v}])["a"].count() == 3


def test_gaussian():
    assert [round(math.exp(-d * d / 20000), 6) for d in (0, 50, 100)] == [1.0, 0.882497, 0.606531]
