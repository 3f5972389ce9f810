"""The toolbox's workflows: integrate, train, apply, validate."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import transverse_mercator
from ..operators import allocate, models, network, parcels, transform
from ..sources import geojson, osm


def assembled(spark: SparkSession, path: str, metric: Callable[[Column, Column], tuple[Column, Column]] = lambda x, y: (x, y)) -> DataFrame:
    """(id, kind, tags, geometry): OpenStreetMap XML as features, with coordinates by ``metric``.

    Tagged nodes are points, tagged ways lines or polygons, and relations of areas
    multipolygons, whose member ways need no tags. Ways are put together once for both.
    """
    t = osm.read(spark, path)

    def at(p: Column) -> Column:
        x, y = metric(p["x"], p["y"])
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    points = osm.points(t["nodes"], t["nodegeoms"])
    rows = points.select("id", F.lit("Point").alias("kind"), "tags", F.array(F.array(F.array(at({"x": F.col("x"), "y": F.col("y")})))).alias("parts"))
    wanted = t["ways"].select("id").union(t["relrefs"].join(t["rels"].select("id"), "id", "left_semi").select("wayref")).distinct()
    lines = network.kept(osm.way_lines(t["wayrefs"].join(wanted, "id", "left_semi"), t["nodegeoms"]))
    ways = osm.way_features(lines, t["ways"])
    rows = rows.unionByName(ways.select("id", "kind", "tags", F.array(F.array(F.transform("pts", at))).alias("parts")))
    members = t["relrefs"].join(t["rels"].select("id"), "id", "left_semi")
    tags = osm.relation_tags(t["rels"], osm.common_tags(members, t["ways"]))
    place = lambda p: at({"x": F.element_at(p, 1), "y": F.element_at(p, 2)})
    areas = osm.relation_polygons(members, lines).join(tags, "id")
    areas = areas.select("id", F.lit("MultiPolygon").alias("kind"), "tags", F.transform("parts", lambda q: F.transform(q, lambda ring: F.transform(ring, place))).alias("parts"))
    return rows.unionByName(areas).select("id", "kind", "tags", F.struct(F.col("kind").alias("type"), "parts").alias("geometry"))


def convert(spark: SparkSession, path: str, out: str, fields: list[str]) -> None:
    """OpenStreetMap XML to lines of GeoJSON Features in degrees, with the tags ``fields`` as properties.

    Coordinates have the depth that each geometry's type asks for.
    """
    rows = assembled(spark, path)
    pair = lambda p: F.array(p["x"], p["y"])
    every = F.transform("geometry.parts", lambda q: F.transform(q, lambda ring: F.transform(ring, pair)))
    first = F.element_at(every, 1)
    depth = {"Point": F.element_at(F.element_at(first, 1), 1), "LineString": F.element_at(first, 1), "Polygon": first, "MultiPolygon": every}
    text = F.coalesce(*(F.when(F.col("kind") == k, F.to_json(v)) for k, v in depth.items()))
    rows = rows.select("kind", text.alias("coordinates"), *(F.col("tags")[f].alias(f) for f in fields))
    geojson.write(geojson.lines_of(rows, F.col("kind"), F.col("coordinates"), fields), out)


def integrate(spark: SparkSession, path: str, config: dict, lon0: float, study: DataFrame | None = None, side: float = 1_000.0) -> dict[str, DataFrame]:
    """OpenStreetMap XML (a file, folder or glob) to thematic layers of points, lines and polygons in metres.

    Each has id, kind, geometry (type, parts) and its attributes; a layer whose configuration
    names a geometry has geometries of that type. study: polygons (id, rings) in metres, to which
    everything is cut, by bins of ``side``.
    """
    rows = assembled(spark, path, lambda x, y: transverse_mercator(x, y, lon0))
    if study is not None:
        rows = network.kept(parcels.clipped_features(rows, study, "id", side))
    return transform.layers(rows, config, geometry_type="kind", geometry="geometry")


def integrate_parts(spark: SparkSession, paths: list[str], config: dict, lon0: float, out: str) -> dict[str, DataFrame]:
    """Each source apart to a workspace below ``out`` (a folder for each part and layer), then layers of one name united.

    For sources that don't share elements, or that come at different times: a part that is there already is
    read and not made again. Overlapping downloads belong into one call of ``integrate``.
    """
    fs = spark._jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for path in paths:
        part = f"{out.rstrip('/')}/{re.sub('[^A-Za-z0-9._-]', '_', path)}"
        names = list(config["layers"])
        done = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{part}/{n}/_SUCCESS"))]
        if len(done) < len(names):
            made = integrate(spark, path, config, lon0)
            geojson.write_layers({n: made[n] for n in names if n not in done}, part)
        found.append({n: spark.read.parquet(f"{part}/{n}") for n in names})
    return geojson.merged(found)


def prepare_training(segments: DataFrame, values: DataFrame, key: str, value: str, area: str, absolute: bool) -> DataFrame:
    """Segments with the sum (absolute, per km2) or mean (relative) of values (key, value); none gives 0."""
    v = F.sum(value) if absolute else F.avg(value)
    out = segments.join(values.groupBy(key).agg(v.alias("__v")), key, "left").withColumn("target", F.coalesce("__v", F.lit(0.0))).drop("__v")
    return out.withColumn("target", F.col("target") / F.col(area) * 1e6) if absolute else out


def prepare_training_dual(segments: DataFrame, polygons: DataFrame, points: DataFrame, key: str, value: str, area: str | None = None, polygon: str | None = None, hit: DataFrame | None = None) -> DataFrame:
    """Segments with a target from polygons and points, each given as (key, value) by segment.

    First polygons that training points lie in go (``hit``: their ids, in the column ``polygon``);
    then point values go where a polygon's reach the segment; with ``area`` the target is per km2.
    Segments without a value have no row.
    """
    if hit is not None:
        polygons = polygons.join(hit.select(polygon).distinct(), polygon, "left_anti")
    a = polygons.groupBy(key).agg(F.sum(value).alias("target"))
    b = points.join(a.select(key), key, "left_anti").groupBy(key).agg(F.sum(value).alias("target"))
    out = segments.join(a.unionByName(b), key)
    return out if area is None else out.withColumn("target", F.try_divide("target", area) * 1e6)


def train(segments: DataFrame, target: str = "target", kind: str = "ols", prefix: str = "FF", weights: dict[str, float] | None = None, pca: bool | float = False) -> models.Model | models.KernelModel:
    """A model (ols, ard or general) of all features with the prefix; weights and principal components: see ``models.prepare``."""
    fit = {"ols": models.fit_ols, "ard": models.fit_ard, "general": models.fit_general}[kind]
    return fit(segments, models.feature_columns(segments, prefix), target, weights=weights, pca=pca)


def score(segments: DataFrame, model: models.Model | models.KernelModel, key: str, name: str = "weight") -> DataFrame:
    """(key, name): a model's scores of segments."""
    if isinstance(model, models.KernelModel):
        return models.score_general(segments, model, key, name)
    return models.apply_linear(segments, model, name).select(key, name)


def apply_model(segments: DataFrame, model: models.Model | models.KernelModel, pieces: DataFrame, key: str, area_id: str, main: str, absolute: bool) -> DataFrame:
    """Scores segments and shares each area's main value over its pieces (key, area_id, piece_area, main)."""
    rows = pieces.join(score(segments, model, key), key)
    if absolute:
        return allocate.transfer_absolute(rows, area_id, main, "weight", "piece_area")
    return allocate.transfer_relative(rows, area_id, main, "weight")


def validate(pieces: DataFrame, truth: DataFrame, key: str, segment: str, model: str, real: str, area: str) -> tuple[DataFrame, DataFrame]:
    """(errors, descriptors) of absolute values: segments share theirs to pieces by area, summed by truth polygon.

    pieces: (segment, key or -1, area, model, real); truth: (key, real).
    """
    shared = allocate.split_by_area(pieces, segment, model, area, "__m")
    done = allocate.add_unmatched(allocate.dissolve(shared, key, "__m", real), truth, key, real)
    return allocate.errors(done), allocate.descriptors(done)
