"""Upkeep of layer tables: flags, columns, types, neighbours, last and largest values."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .network import kept

#: From the narrowest type to the widest: the pattern of its values.
TYPES = {"bigint": r"^[+-]?\d{1,18}$", "double": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", "string": r"(?s)^.*$"}


def flagged(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """``df`` with a boolean: whether the row meets the condition; null counts as no."""
    return df.withColumn(name, F.coalesce(condition, F.lit(False)))


def rejected(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that don't meet the condition, those on which it's null among them."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def reshaped(df: DataFrame, keep: list[str] | None = None, copies: dict[str, str] | None = None, computed: dict[str, Column] | None = None, typed: dict[str, str] | None = None) -> DataFrame:
    """Kept columns (all by default), then copies (new name: column), computed and empty typed ones."""
    copied = [F.col(old).alias(new) for new, old in (copies or {}).items()]
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (typed or {}).items()]
    return df.select(*(keep if keep is not None else df.columns), *copied, *(c.alias(n) for n, c in (computed or {}).items()), *empty)


def mapped(df: DataFrame, function: Callable[..., Column], columns: list[str], name: str) -> DataFrame:
    """``df`` with a user's function of some columns; the function gives a Column, or is a pandas UDF."""
    return df.withColumn(name, function(*(F.col(c) for c in columns)))


def inferred(df: DataFrame, key: str, columns: list[str], probe: int = 5) -> DataFrame:
    """Text columns as the type of most of their first ``probe`` non-null values by key; the wider type on a tie.

    Values that aren't of that type become null. Only the probed values are looked at: ``probe`` a column.
    """
    for c in columns:
        kind = F.coalesce(*(F.when(F.col(c).rlike(p), F.lit(i)) for i, p in enumerate(TYPES.values())))
        first = df.where(F.col(c).isNotNull()).orderBy(key, c).limit(probe).select(kind.alias("k"))
        best = first.groupBy("k").count().orderBy(F.desc("count"), F.desc("k")).first()
        if best is not None:
            df = df.withColumn(c, F.col(c).try_cast(list(TYPES)[best["k"]]))
    return df


def write_layer(df: DataFrame, path: str, slots: dict[str, str], types: dict[str, str] | None = None, key: str | None = None) -> None:
    """Parquet with the slots (column: field) renamed; types given, or inferred for text columns where ``key`` is."""
    out = df.select(*(F.col(c).alias(f) for c, f in slots.items()))
    for field, kind in (types or {}).items():
        out = out.withColumn(field, F.col(field).try_cast(kind))
    if key is not None:
        out = inferred(out, key, [f for f, kind in out.dtypes if kind == "string" and f not in (types or {})])
    out.write.mode("overwrite").parquet(path)


def neighbours(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """(zone, neighbour): both ways, each once. A hub's list stays in rows, as it may be long."""
    ways = pairs.select(F.col(source).alias("zone"), F.col(target).alias("neighbour"))
    return ways.union(ways.select("neighbour", "zone")).where("zone != neighbour").distinct()


def last_values(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, value) of the last row by ``order``; ties go to the greater value."""
    last = F.max(F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), F.col(value).alias("v")))
    return df.groupBy(*keys).agg(last.alias("__l")).select(*keys, F.col("__l.v").alias(value))


def top_key(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, key, value): the key of the largest sum; ties go to the least key. Keys are summed before groups meet."""
    sums = df.groupBy(group, key).agg(F.sum(value).alias("v"))
    best = sums.groupBy(group).agg(F.min(F.struct((-F.col("v")).alias("v"), F.col(key).alias("k"))).alias("b"))
    return best.select(group, F.col("b.k").alias(key), (-F.col("b.v")).alias(value))


def homogenised(edges: DataFrame, attributes: list[str], ends: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """Edges dissolved by their attributes: equal ones, in either direction, become one."""
    half = len(ends) // 2
    a, b = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(ends[:half]))), F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(ends[half:])))
    one = edges.select(*attributes, F.least(a, b).alias("__a"), F.greatest(a, b).alias("__b")).distinct()
    return one.select(*attributes, *(F.col(f"__{s}.k{i}").alias(c) for s, part in (("a", ends[:half]), ("b", ends[half:])) for i, c in enumerate(part)))


def dissolved(edges: DataFrame, attributes: list[str], rounds: int = 60) -> DataFrame:
    """(attributes, line, length, pts): edges (x1, y1, x2, y2) of equal attributes joined to single lines between forks and ends.

    Equal edges are one first. Where exactly two edges of equal attributes meet, they belong to one line;
    forks and ends part lines, and a closed line begins at its least corner. Edges are named by
    doubling: in a round each takes the least name of the two it points to along the line, and points twice as far, so
    a line of n edges takes about log2(n) rounds. line is the least edge's hash. A line's own corners are put in
    order in one row.
    """
    one = homogenised(edges, attributes).where("x1 != x2 or y1 != y2")
    corner = lambda i: F.struct(F.col(f"x{i}").cast("double").alias("x"), F.col(f"y{i}").cast("double").alias("y"))
    rows = kept(one.select(F.struct(*(F.col(a) for a in attributes)).alias("at"), corner(1).alias("p"), corner(2).alias("q")).withColumn("e", F.xxhash64("at", "p", "q")))
    ends = rows.select("at", "e", F.col("p").alias("v")).union(rows.select("at", "e", F.col("q").alias("v")))
    joints = ends.groupBy("at", "v").agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("a"), F.max("e").alias("b")).where("n = 2 and a != b")
    links = kept(joints.select("a", "b").union(joints.select(F.col("b"), F.col("a"))).toDF("e", "other"))
    # In round k an edge hears from those 2**k away on either side; nearer ones were heard before.
    names = kept(rows.select("e", F.col("e").alias("name")))
    reach = links
    for _ in range(rounds):
        heard = reach.join(names.withColumnRenamed("e", "other").withColumnRenamed("name", "far"), "other").groupBy("e").agg(F.min("far").alias("far"))
        fresh = kept(names.join(heard, "e", "left").select("e", F.least("name", "far").alias("name"), (F.col("far") < F.col("name")).alias("moved")))
        done = fresh.where("moved").isEmpty()
        names = fresh.select("e", "name")
        if done:
            break
        two = reach.alias("l").join(reach.alias("r"), F.col("l.other") == F.col("r.e")).select(F.col("l.e").alias("e"), F.col("r.other").alias("other")).where("e != other")
        reach = kept(two.distinct())
    else:
        raise RuntimeError(f"names still change after {rounds} rounds")

    def chain(edges: list[dict]) -> tuple[float, list[dict]]:
        near: dict[tuple, list[tuple]] = {}
        for e in edges:
            a, b = ((v["x"], v["y"]) for v in (e["p"], e["q"]))
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        at, last = min([v for v, around in near.items() if len(around) != 2] or near), None
        way = [at]
        for _ in edges:
            last, at = at, min(v for v in near[at] if v != last)
            way.append(at)
        length = sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in zip(way, way[1:], strict=False))
        return length, [{"x": x, "y": y} for x, y in way]

    def run(batches):
        for batch in batches:
            made = [chain(edges) for edges in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))], ["at", "line", "length", "pts"])

    told = rows.join(names, "e").groupBy("at", F.col("name").alias("line")).agg(F.collect_list(F.struct("p", "q")).alias("edges"))
    out = told.mapInArrow(run, f"at {rows.schema['at'].dataType.simpleString()}, line long, length double, pts array<struct<x double, y double>>")
    return out.select("at.*", "line", "length", "pts")
