"""GeoJSON in and out, layer tables, and merging of workspaces."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FEATURE = "type string, geometry struct<type string, coordinates string>, properties map<string, string>"


def read(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(kind, coordinates, properties): coordinates as JSON text, properties as a map.

    ``lines``: one Feature a line, which splits among tasks; else FeatureCollections, a
    file each.
    """
    if lines:
        return spark.read.schema(_FEATURE).json(path).select(F.col("geometry.type").alias("kind"), F.col("geometry.coordinates").alias("coordinates"), "properties")
    files = spark.read.schema(f"features array<struct<{_FEATURE.replace('type string', 'type: string', 1).replace('geometry struct', 'geometry: struct').replace('properties map', 'properties: map').replace('struct<type string, coordinates string>', 'struct<type: string, coordinates: string>')}>>").option("multiLine", True).json(path)
    return files.select(F.explode("features").alias("f")).select(F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def lines_of(df: DataFrame, kind: Column, coordinates: Column, fields: list[str]) -> DataFrame:
    """(value): one Feature of JSON each; declared fields are all there, null where missing.

    coordinates: a nested array Column, or JSON text.
    """
    props = F.to_json(F.struct(*(F.col(f) for f in fields)), {"ignoreNullFields": "false"})
    shape = coordinates if dict(df.select(coordinates.alias("c")).dtypes)["c"] == "string" else F.to_json(coordinates)
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":{"type":'), F.to_json(F.array(kind)).substr(F.lit(2), F.length(F.to_json(F.array(kind))) - 2), F.lit(',"coordinates":'), shape, F.lit('},"properties":'), props, F.lit("}")).alias("value"))


def write(features: DataFrame, path: str, rows_per_file: int = 250_000) -> None:
    """Writes Feature lines, split in files of at most ``rows_per_file``."""
    features.write.option("maxRecordsPerFile", rows_per_file).text(path)


def layer(df: DataFrame, slots: dict[str, str], where: str | None = None, constants: dict | None = None, converters: dict[str, Callable[[Column], Column]] | None = None, order: list[str] | None = None) -> DataFrame:
    """Columns renamed to slots, with a filter, constant slots, a converter of Columns per slot, and rows sorted by slots.

    Nulls come first in the order; a range of it is one partition, so files written from it are sorted in a row.
    """
    out = df.where(where) if where else df
    same = lambda c: c
    out = out.select(*((converters or {}).get(s, same)(F.col(c)).alias(s) for s, c in slots.items()), *(F.lit(v).alias(s) for s, v in (constants or {}).items()))
    return out.orderBy(*order) if order else out


def merged(workspaces: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Layers of the same name united, with missing columns as null."""
    names = dict.fromkeys(n for w in workspaces for n in w)
    return {n: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [w[n] for w in workspaces if n in w]) for n in names}


def write_layers(layers: dict[str, DataFrame], path: str) -> None:
    for name, df in layers.items():
        df.write.parquet(f"{path.rstrip('/')}/{name}")


def updated(df: DataFrame, values: DataFrame, key: str, columns: list[str], default: float | None = None, strict: bool = False) -> DataFrame:
    """``df`` with ``columns`` attached by key; missing rows get ``default``, or with ``strict`` raise."""
    v = values.select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__hit"))
    out = df.join(v, key, "left")
    for c in columns:
        missing = F.raise_error(F.concat(F.lit("no value for "), F.col(key).cast("string"))).cast("double") if strict else F.lit(default)
        out = out.withColumn(c, F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(missing))
    return out.drop("__hit", *(f"__{c}" for c in columns))
