"""Category, summary, window and flow aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.selectors import any_prefix, first_prefix


def category_sums(df: DataFrame, key: str, category: str, weight: str, categories: list[str], prefix: str = "c_", area: str | None = None) -> DataFrame:
    """Weight by listed category, a column each; unlisted categories have no column. With ``area``, per unit of it."""
    total = lambda c: F.coalesce(F.sum(F.when(F.col(category) == c, F.col(weight))), F.lit(0.0))
    per = F.first(area) if area else F.lit(1.0)
    return df.groupBy(key).agg(*((F.coalesce(F.try_divide(total(c), per), F.lit(0.0))).alias(f"{prefix}{c}") for c in categories))


def category_fractions(df: DataFrame, key: str, category: str, weight: str, categories: list[str], prefix: str = "f_") -> DataFrame:
    """Shares of the listed categories in their sum; a zero sum leaves zeros."""
    sums = category_sums(df, key, category, weight, categories, "__")
    total = reduce(lambda a, b: a + b, (F.col(f"__{c}") for c in categories))
    return sums.select(key, *(F.coalesce(F.try_divide(F.col(f"__{c}"), total), F.lit(0.0)).alias(f"{prefix}{c}") for c in categories))


def prefix_fractions(df: DataFrame, key: str, code: str, weight: str, prefixes: list[str], out: str = "p_") -> DataFrame:
    """Shares in all non-null codes read; a code belongs to the first prefix that it begins with."""
    group = first_prefix(F.col(code), prefixes)
    rows = df.where(F.col(code).isNotNull()).withColumn("__g", group)
    return rows.groupBy(key).agg(*(F.coalesce(F.try_divide(F.sum(F.when(F.col("__g") == p, F.col(weight)).otherwise(0.0)), F.sum(weight)), F.lit(0.0)).alias(f"{out}{p}") for p in prefixes))


def merged_sums(df: DataFrame, key: str, subtype: str, weight: Column, groups: dict[str, list[str]], prefix: str = "g_") -> DataFrame:
    """Sums by group of subtypes."""
    return df.groupBy(key).agg(*(F.coalesce(F.sum(F.when(F.col(subtype).isin(members), weight)), F.lit(0.0)).alias(f"{prefix}{g}") for g, members in groups.items()))


def filtered(df: DataFrame, category: str, wanted: list[list[str] | None], prefixes: bool = False) -> DataFrame:
    """Rows that several aggregators read, given the categories (or prefixes) of each: filtered only where all of them agree.

    None stands for an aggregator that reads everything. The filter reaches the scan.
    """
    first = wanted[0] if wanted else None
    if first is None or any(w is None or set(w) != set(first) for w in wanted):
        return df
    return df.where(any_prefix(F.col(category), first) if prefixes else F.col(category).isin(first))


def summaries(df: DataFrame, key: str, value: str, weight: str, prefix: str = "") -> DataFrame:
    """sum, mean, median, wsum, wmean, wmedian by key.

    The weighted median is the least value at which the running weight reaches half the
    total. Equal values are summed first, so the window sorts distinct values alone.
    """
    plain = df.groupBy(key).agg(F.sum(value).alias(f"{prefix}sum"), F.avg(value).alias(f"{prefix}mean"), F.median(value).alias(f"{prefix}median"), F.sum(F.col(value) * F.col(weight)).alias(f"{prefix}wsum"), F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(f"{prefix}wmean"))
    return plain.join(weighted_median(df, key, value, weight, f"{prefix}wmedian"), key)


def weighted_median(df: DataFrame, key: str, value: str, weight: str, name: str = "wmedian") -> DataFrame:
    points = df.groupBy(key, value).agg(F.sum(weight).alias("w"))
    run = F.sum("w").over(W.partitionBy(key).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("w").over(W.partitionBy(key))
    return points.select(key, value, run.alias("run"), total.alias("total")).where(2 * F.col("run") >= F.col("total")).groupBy(key).agg(F.min(value).alias(name))


def general_mode(df: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """Generalised mode: for each offset cut the sorted values in runs of ``size`` (the first and
    last may be shorter, but hold two values), take the run of least width per value, average
    it; the median of those averages. Fewer values than ``size``: the least value."""
    if size < 2:
        return df.groupBy(key).agg(F.min(value).alias("mode"))
    at = F.row_number().over(W.partitionBy(key).orderBy(value)) - 1
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    rows = df.select(key, F.col(value).alias("v"), at.alias("rn"), n.alias("n"))
    short = rows.where(F.col("n") < size).groupBy(key).agg(F.min("v").alias("mode"))
    cut = rows.where(F.col("n") >= size).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("run", F.floor((F.col("rn") + F.col("o")) / size))
    runs = cut.groupBy(key, "o", "run").agg(F.avg("v").alias("a"), ((F.max("v") - F.min("v")) / F.count(F.lit(1))).alias("width"), F.count(F.lit(1)).alias("k"))
    full = runs.where(F.col("k") >= 2)
    best = full.groupBy(key, "o").agg(F.min_by("a", F.struct("width", "run")).alias("a"))
    return best.groupBy(key).agg(F.median("a").alias("mode")).union(short)


def point_means(points: DataFrame, key: str, value: str, weight: str, name: str = "mean") -> DataFrame:
    """Weighted mean in which a null value adds 0 but its weight counts."""
    return points.groupBy(key).agg(F.coalesce(F.try_divide(F.sum(F.coalesce(F.col(value), F.lit(0.0)) * F.col(weight)), F.sum(weight)), F.lit(0.0)).alias(name))


def flows(df: DataFrame, source: str, target: str, *values: str) -> DataFrame:
    """Component-wise sums by directed pair. Hub zones are summed before the shuffle."""
    return df.groupBy(F.col(source).alias("src"), F.col(target).alias("dst")).agg(*(F.sum(v).alias(v) for v in values))


def zone_totals(pairs: DataFrame, value: str) -> DataFrame:
    """(zone, outflow, inflow)."""
    both = pairs.select(F.col("src").alias("zone"), F.col(value).alias("o"), F.lit(0.0).alias("i")).union(pairs.select(F.col("dst"), F.lit(0.0), F.col(value)))
    return both.groupBy("zone").agg(F.sum("o").alias("outflow"), F.sum("i").alias("inflow"))


def raw_flows(pairs: DataFrame, zones: DataFrame, value: str) -> DataFrame:
    """Flow to zones that aren't in ``zones``, pooled by origin: (src, raw, failures)."""
    known = zones.select(F.col(zones.columns[0]).alias("dst"), F.lit(True).alias("known")).distinct()
    miss = F.col("known").isNull()
    return pairs.join(known, "dst", "left").groupBy("src").agg(F.coalesce(F.sum(F.when(miss, F.col(value))), F.lit(0.0)).alias("raw"), F.sum(F.when(miss, 1).otherwise(0)).alias("failures"))


def two_sided(pairs: DataFrame, value: str) -> DataFrame:
    """(a, b, out, in, has_out, has_in) for each unordered pair a <= b that has a flow."""
    a, b = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    ahead = F.col("src") <= F.col("dst")
    out = pairs.select(a, b, F.when(ahead, F.col(value)).alias("o"), F.when(~ahead | (F.col("src") == F.col("dst")), F.col(value)).alias("i"))
    return out.groupBy("a", "b").agg(F.coalesce(F.sum("o"), F.lit(0.0)).alias("out"), F.coalesce(F.sum("i"), F.lit(0.0)).alias("in"), F.max(F.when(F.col("o").isNotNull(), 1).otherwise(0)).alias("has_out"), F.max(F.when(F.col("i").isNotNull(), 1).otherwise(0)).alias("has_in"))


def sideless(rows: DataFrame, source: str, target: str, values: DataFrame, value: str) -> DataFrame:
    """``rows`` with the value of (source, target), else of (target, source), else null."""
    one = values.select(F.col("src").alias("__s"), F.col("dst").alias("__t"), F.col(value).alias("__v"))
    two = values.select(F.col("src").alias("__s2"), F.col("dst").alias("__t2"), F.col(value).alias("__v2"))
    out = rows.join(one, (F.col(source) == F.col("__s")) & (F.col(target) == F.col("__t")), "left").join(two, (F.col(source) == F.col("__t2")) & (F.col(target) == F.col("__s2")), "left")
    return out.withColumn(value, F.coalesce("__v", "__v2")).drop("__s", "__t", "__v", "__s2", "__t2", "__v2")


def natural_breaks(df: DataFrame, key: str, value: str, classes: int) -> DataFrame:
    """(key, break_no, upper): upper ends of the classes of least squared deviation (exact dynamic programme).

    Values are reduced to (value, count) first; a group's distinct values go to one task,
    so round continuous values to a grid before.
    """
    import numpy as np
    import pandas as pd

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        v, n = pdf["v"].to_numpy(float), pdf["n"].to_numpy(float)
        m, k = len(v), min(classes, len(v))
        c, s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (n, n * v, n * v * v))
        cost = np.full((k + 1, m + 1), np.inf)
        cost[0, 0] = 0
        back = np.zeros((k + 1, m + 1), int)
        for j in range(1, k + 1):
            for i in range(j, m + 1):
                at = np.arange(j - 1, i)
                total = cost[j - 1, at] + (q[i] - q[at]) - (s[i] - s[at]) ** 2 / (c[i] - c[at])
                b = int(total.argmin())
                cost[j, i], back[j, i] = total[b], at[b]
        ends, i = [], m
        for j in range(k, 0, -1):
            ends.append(v[i - 1])
            i = back[j, i]
        return pd.DataFrame({key: pdf[key].iloc[0], "break_no": range(1, k + 1), "upper": ends[::-1]})

    counts = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).applyInPandas(best, f"{key} {df.schema[key].dataType.simpleString()}, break_no int, upper double")
