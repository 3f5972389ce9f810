"""Features of parcels by name: containment, neighbourhood, terrain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import aggregate, raster, spatial
from .network import kept


def buildings(pieces: DataFrame, segment: str = "seg_id", size: str = "AREA", shape: str = "WAG", area: str = "piece_area") -> DataFrame:
    """FFcbsize_* and FFcbwag_*: size and shape of the whole building, weighted by the piece inside."""
    s = aggregate.summaries(pieces, segment, size, area, "s_")
    w = aggregate.summaries(pieces, segment, shape, area, "w_")
    return s.join(w, segment).select(segment, *(F.col(f"s_{f}").alias(f"FFcbsize_{f}") for f in ("sum", "mean", "median")), *(F.col(f"w_{f}").alias(f"FFcbwag_{f}") for f in ("mean", "median", "wmean", "wmedian")))


def land_use(pieces: DataFrame, codes: list[str], segment: str = "seg_id", code: str = "code", area: str = "piece_area") -> DataFrame:
    """FFcluf<code>: shares of land-use codes by overlap area."""
    return aggregate.prefix_fractions(pieces, segment, code, area, codes, "FFcluf")


def poi_use(points: DataFrame, groups: dict[str, list[str]], segment: str = "seg_id", subtype: str = "subtype", area: str = "area") -> DataFrame:
    """FFcp<group>: points of interest per square metre of the parcel."""
    counts = aggregate.merged_sums(points, segment, subtype, F.lit(1.0), groups, "__")
    areas = points.groupBy(segment).agg(F.first(area).alias("__area"))
    return counts.join(areas, segment).select(segment, *(F.coalesce(F.try_divide(F.col(f"__{g}"), F.col("__area")), F.lit(0.0)).alias(f"FFcp{g}") for g in groups))


def poi_proximity(targets: DataFrame, points: DataFrame, groups: dict[str, list[str]], sd: float, key: str = "id", subtype: str = "subtype") -> DataFrame:
    """FFpp<group>: Gaussian sums of points of interest within 5 sd. Points of one place and subtype are one, targets of one place meet them once."""
    some = points.groupBy("px", "py", subtype).agg(F.count(F.lit(1)).alias("__n"))
    near = spatial.within_range(targets.select("x", "y").distinct(), some, 5 * sd).withColumn("__w", F.col("__n") * spatial.gaussian_weight(F.col("distance"), sd)).withColumn("__at", F.struct("x", "y"))
    sums = aggregate.merged_sums(near, "__at", subtype, F.col("__w"), groups, "FFpp").select("__at.x", "__at.y", *(f"FFpp{g}" for g in groups))
    return targets.select(key, "x", "y").join(sums, ["x", "y"]).groupBy(key).agg(*(F.sum(f"FFpp{g}").alias(f"FFpp{g}") for g in groups))


def neighbourhood_land_use(cells: DataFrame, codes: list[str], sd: float, size: float, code: str = "code") -> DataFrame:
    """(i, j, FFpluf<code>): Gaussian shares of codes around each cell; cells without data don't count."""
    sums = raster.neighbour_sums(cells, raster.gaussian_mask(sd, size), code).withColumn("__c", F.struct("i", "j"))
    return aggregate.prefix_fractions(sums, "__c", code, "w", codes, "FFpluf").select("__c.i", "__c.j", *(f"FFpluf{c}" for c in codes))


def terrain(dem: DataFrame, size: float, smoothing: float) -> DataFrame:
    """(i, j, FFslope, FFwest, FFsouth, FFhperc) of a DEM smoothed by a median in a circle; cells at its edge have no slope."""
    smooth = kept(raster.focal_median(dem, smoothing, size))
    t = raster.terrain(smooth, size).select("i", "j", F.col("slope").alias("FFslope"), F.col("westness").alias("FFwest"), F.col("southness").alias("FFsouth"))
    h = raster.value_percentiles(smooth).select("i", "j", F.col("percentile").alias("FFhperc"))
    return h.join(t, ["i", "j"], "left")


def to_segments(points: DataFrame, features: list[str], segment: str = "seg_id", weight: str = "WT_AREA") -> DataFrame:
    """Means of point features by parcel, weighted by the area that a point stands for; none gives 0."""
    w = F.sum(weight)
    return points.groupBy(segment).agg(*(F.coalesce(F.try_divide(F.sum(F.coalesce(F.col(f), F.lit(0.0)) * F.col(weight)), w), F.lit(0.0)).alias(f) for f in features))


def widened(segments: DataFrame, parts: list[DataFrame], key: str = "seg_id") -> DataFrame:
    """All features under one id; absent ones are 0."""
    out = reduce(lambda a, b: a.join(b, key, "left"), parts, segments)
    return out.fillna(0.0, [c for p in parts for c in p.columns if c != key])
