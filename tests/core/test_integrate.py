"""OpenStreetMap XML to layers and to GeoJSON; geometries as points."""

import json

import pytest
from pyspark.sql import functions as F

from parcelwise.functions.geometry import polygon_area
from parcelwise.jobs import pipelines
from parcelwise.operators import transform

XML = """<osm version="0.6">
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


@pytest.fixture
def source(tmp_path):
    path = tmp_path / "map.osm"
    path.write_text(XML)
    return str(path)


def test_assembled(spark, source):
    got = {r["id"]: r for r in pipelines.assembled(spark, source).withColumn("area", F.when(F.col("kind") == "MultiPolygon", polygon_area(F.col("geometry.parts")))).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {5: "Point", 10: "LineString", 11: "LineString", 20: "MultiPolygon"}
    assert got[5]["tags"] == {"amenity": "pub"} and got[20]["tags"] == {"landuse": "grass"}
    assert got[20]["area"] == 15.5 and [len(p) for p in got[20]["geometry"]["parts"]] == [2]


def test_integrate(spark, source):
    config = {"layers": {
        "poi": {"geometry": "Point", "selector": {"amenity": True}, "attributes": [{"name": "amenity", "getter": {"get": "amenity"}}]},
        "green": {"geometry": "Polygon", "input-geometries": ["polygon"], "selector": {"landuse": ["grass"]}, "attributes": [{"name": "landuse", "getter": {"get": "landuse"}}]},
        "spots": {"geometry": "Point", "selector": {"landuse": True}, "attributes": [{"name": "name", "getter": {"get": "name"}}]},
    }}
    found = pipelines.integrate(spark, source, config, 3.0)
    poi, green = found["poi"].collect(), found["green"].collect()
    assert [(r["id"], r["amenity"], r["geometry"]["type"]) for r in poi] == [(5, "pub", "Point")]
    assert [(r["id"], r["geometry"]["type"], [len(p) for p in r["geometry"]["parts"]]) for r in green] == [(20, "Polygon", [2])]
    assert green[0]["geometry"]["parts"][0][0][0]["x"] > 1000  # metres
    assert sorted(r["id"] for r in found["spots"].collect()) == [10, 11, 20]


def test_convert(spark, source, tmp_path):
    pipelines.convert(spark, source, str(tmp_path / "out"), ["landuse", "amenity"])
    got = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    by_kind = {g["geometry"]["type"]: g for g in got}
    assert len(got) == 4 and by_kind["Point"]["geometry"]["coordinates"] == [1.0, 1.0]
    assert by_kind["Point"]["properties"] == {"landuse": None, "amenity": "pub"}
    assert len(by_kind["LineString"]["geometry"]["coordinates"]) == 3
    assert [len(r) for r in by_kind["MultiPolygon"]["geometry"]["coordinates"][0]] == [5, 4]


def test_points_of_geometries(spark):
    square = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]]
    cases = [
        (1, ("Point", [[[(3.0, 4.0)]]])),
        (2, ("MultiPoint", [[[(0.0, 0.0)]], [[(2.0, 4.0)]]])),
        (3, ("LineString", [[[(0.0, 0.0), (1.0, 1.0), (5.0, 5.0)]]])),
        (4, ("Polygon", [square])),
        (5, ("MultiPolygon", [square, [[(10.0, 0.0), (14.0, 0.0), (14.0, 4.0), (10.0, 4.0), (10.0, 0.0)]]])),
        (6, ("Polygon", [[[(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (1.0, 1.0)]]])),  # concave: its hull counts
        (7, ("Polygon", [])),
    ]
    df = spark.createDataFrame(cases, "id long, geometry struct<type string, parts array<array<array<struct<x double, y double>>>>>")
    got = {}
    for r in transform.retyped(df, "Point").collect():
        got.setdefault(r["id"], []).append(tuple(round(v, 6) for v in r["geometry"]["parts"][0][0][0]))
    assert got == {1: [(3, 4)], 2: [(0, 0), (2, 4)], 3: [(1, 1)], 4: [(1, 1)], 5: [(9.8, 1.8)], 6: [(1.333333, 1.333333)]}
