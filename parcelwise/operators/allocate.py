"""Proportional allocation of coarse totals, and its validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .network import kept
from .ranks import order_statistics

QUANTILES = (0.025, 0.1, 0.25, 0.75, 0.9, 0.975)


def allocate(df: DataFrame, group: str, main: str, weight: str, name: str = "value") -> DataFrame:
    """main * weight / sum of the group's weights; null where that sum is 0.

    Groups can be few and huge: sums are taken before the shuffle and joined back.
    """
    sums = df.groupBy(group).agg(F.sum(weight).alias("__w"))
    return df.join(sums, group).withColumn(name, F.try_divide(F.col(main) * F.col(weight), F.col("__w"))).drop("__w")


def transfer_absolute(df: DataFrame, group: str, main: str, weight: str, area: str, name: str = "value") -> DataFrame:
    """Shares of main by weight * area / 1e6; weights up to 0 get 0, and a group without weight gets 0."""
    w = F.when(F.col(weight) > 0, F.col(weight) * F.col(area) / 1e6).otherwise(0.0)
    rows = df.withColumn("__p", w)
    sums = rows.groupBy(group).agg(F.sum("__p").alias("__w"))
    return rows.join(sums, group).withColumn(name, F.coalesce(F.try_divide(F.col(main) * F.col("__p"), F.col("__w")), F.lit(0.0))).drop("__p", "__w")


def transfer_relative(df: DataFrame, group: str, main: str, weight: str, prior: str | None = None, name: str = "value") -> DataFrame:
    """main * weight scaled so that the mean, weighted by ``prior`` (else 1), is main again."""
    a = F.coalesce(F.col(prior), F.lit(1.0)) if prior else F.lit(1.0)
    sums = df.groupBy(group).agg(F.try_divide(F.sum(a), F.sum(F.col(weight) * a)).alias("__c"))
    return df.join(sums, group).withColumn(name, F.col(main) * F.col(weight) * F.col("__c")).drop("__c")


def split_by_area(pieces: DataFrame, source: str, value: str, area: str, name: str = "value") -> DataFrame:
    """Pieces share their source's value by area (absolute values of polygons)."""
    return allocate(pieces, source, value, area, name)


def dissolve(pieces: DataFrame, key: str, model: str, real: str) -> DataFrame:
    """(key, model, real): model summed and real once per key; rows with key -1 stay apart, each as its own."""
    inside = pieces.where(F.col(key) != -1).groupBy(key).agg(F.sum(model).alias("model"), F.first(real).alias("real"))
    outside = pieces.where(F.col(key) == -1).select(F.col(key), F.col(model).alias("model"), F.lit(0.0).alias("real"))
    return inside.unionByName(outside)


def add_unmatched(done: DataFrame, truth: DataFrame, key: str, real: str) -> DataFrame:
    """Truth that no segment touches joins with a model value of 0."""
    rest = truth.join(done.select(key).distinct(), key, "left_anti").select(key, F.lit(0.0).alias("model"), F.col(real).alias("real"))
    return done.unionByName(rest)


def errors(df: DataFrame, model: str = "model", real: str = "real") -> DataFrame:
    """One row: n, mismatch, tae, rtae, rmse, r2; nulls count as 0. Two passes over a table that is written once, for the mean comes first."""
    v = kept(df.select(F.coalesce(F.col(model), F.lit(0.0)).alias("m"), F.coalesce(F.col(real), F.lit(0.0)).alias("r")))
    mean = v.agg(F.avg("r").alias("mean"))
    d = F.col("m") - F.col("r")
    out = v.crossJoin(F.broadcast(mean)).agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("mismatch"), F.sum(F.abs(d)).alias("tae"), F.sum("r").alias("sr"), F.sum(d * d).alias("ss"), F.sum((F.col("r") - F.col("mean")) ** 2).alias("st"))
    return out.select("n", "mismatch", "tae", F.try_divide("tae", "sr").alias("rtae"), F.sqrt(F.try_divide(F.col("ss"), F.col("n"))).alias("rmse"), (1 - F.try_divide("ss", "st")).alias("r2"))


def descriptors(df: DataFrame, model: str = "model", real: str = "real") -> DataFrame:
    """sum, min, max, mean, median and six quantiles of model, real, residual and absolute residual.

    Nulls count as 0; NaN is the greatest value, and makes sums and means NaN. No rows give no rows.
    """
    m, r = F.coalesce(F.col(model), F.lit(0.0)).cast("double"), F.coalesce(F.col(real), F.lit(0.0)).cast("double")
    both, d = kept(df.select(m.alias("m"), r.alias("r"))), F.col("m") - F.col("r")
    rows = both.select(F.explode(F.create_map(F.lit("model"), "m", F.lit("real"), "r", F.lit("residual"), d, F.lit("abs_residual"), F.abs(d))).alias("dataset", "v"))
    found = order_statistics(rows, "dataset", "v", (0.5, *QUANTILES))
    names = ["median", *(f"q{str(x * 100).rstrip('0').rstrip('.').replace('.', '_')}" for x in QUANTILES)]
    table = df.sparkSession.createDataFrame([(g, *(float(q[x]) for x in (0.5, *QUANTILES))) for g, q in found.items()], "dataset string, " + ", ".join(f"{n} double" for n in names))
    out = rows.groupBy("dataset").agg(F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"))
    return out.join(F.broadcast(table), "dataset").select("dataset", "sum", "min", "max", "mean", *names)
