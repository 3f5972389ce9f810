"""From one feature table to thematic layers, by a configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.selectors import getter, selector, typed
from .spatial import representative

#: A simple geometry name covers its multiple too.
GEOMETRIES = {"point": ["Point", "MultiPoint"], "line": ["LineString", "MultiLineString"], "polygon": ["Polygon", "MultiPolygon"]}


def layer(features: DataFrame, config: dict, tags: str = "tags", geometry_type: str | None = None, geometry: str | None = None) -> DataFrame:
    """One layer: rows that fit, with an attribute column each.

    Selectors read tags alone, so they can run before geometries are assembled. Attributes
    with ``selection: restrict`` drop rows in which they are null. List attributes give a
    row for each element; several go in lock-step, the shorter filled with nulls. With the
    column ``geometry`` (type, parts), geometries get the type that the configuration names.
    """
    t = F.col(tags)
    out = features.where(selector(config["selector"], t))
    if geometry_type and config.get("input-geometries"):
        out = out.where(F.col(geometry_type).isin([g for k in config["input-geometries"] for g in GEOMETRIES[k]]))
    keep = [c for c in features.columns if c != tags]
    lists, plain = [], {}
    for a in config["attributes"]:
        value = getter(a["getter"], t)
        if "more" in a["getter"]:
            lists.append(a)
            plain[a["name"]] = value
        else:
            plain[a["name"]] = typed(value, a.get("type", "string"))
    out = out.select(*keep, *(c.alias(n) for n, c in plain.items()))
    if lists:
        names = [a["name"] for a in lists]
        out = out.withColumn("__z", F.explode(F.arrays_zip(*names))).select(*[c for c in out.columns if c not in names], *(typed(F.col(f"__z.{a['name']}"), a.get("type", "string")).alias(a["name"]) for a in lists))
    for a in config["attributes"]:
        if a.get("selection") == "restrict":
            out = out.where(F.col(a["name"]).isNotNull())
    out = out.select(*keep, *(a["name"] for a in config["attributes"]))
    return retyped(out, config["geometry"], geometry) if geometry and config.get("geometry") else out


def layers(features: DataFrame, config: dict, tags: str = "tags", geometry_type: str | None = None, geometry: str | None = None) -> dict[str, DataFrame]:
    """All layers of a transformer configuration, each a narrow pass over the same table."""
    return {name: layer(features, c, tags, geometry_type, geometry) for name, c in config["layers"].items()}


def retyped(features: DataFrame, want: str, geometry: str = "geometry") -> DataFrame:
    """Geometry (type, parts of rings of vertices) of the wanted type.

    The same stays; multiple to single gives a row per part; anything becomes a point by its
    representative point; others raise. Rows whose geometry has no part go.
    """
    kind, parts = F.col(f"{geometry}.type"), F.col(f"{geometry}.parts")
    fail = F.raise_error(F.concat(F.lit(f"can't make {want} of "), kind))
    single = F.transform(parts, lambda p: F.array(p))
    if want == "Point":
        fail = F.array(F.array(F.array(F.array(representative(kind, parts)))))
    each = F.when(kind == want, F.array(parts)).when(kind == f"Multi{want}", single).otherwise(fail)
    rest = [c for c in features.columns if c != geometry]
    return features.where(F.size(parts) > 0).select(*rest, F.explode(each).alias("__p")).select(*rest, F.struct(F.lit(want).alias("type"), F.col("__p").alias("parts")).alias(geometry))
