"""Helpers that every operator of the subpackage shares."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a local session (tests, a laptop) makes and sets a temporary folder;
    a cluster's executors wouldn't see it, so there it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="parcelwise-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found


_scopes: list[list[DataFrame]] = []


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which cuts its lineage.

    The table goes when the application ends, or by ``free``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """The tables that are saved inside, for a later ``free``."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.pop()


def free(spark: SparkSession, tables: list[DataFrame]) -> None:
    """Delete saved tables that nothing will read again, and let Spark drop the shuffle files of plans that are gone."""
    for table_ in tables:
        at = spark._jvm.org.apache.hadoop.fs.Path(table_._saved_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    tables.clear()
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, most: int, longs: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; else as it is.

    The caller states how many rows of its width are safe to broadcast, and gets a
    shuffled join beyond that. longs: size of a row, where rows differ; ``most`` then
    bounds the sum.
    """
    if longs is None:
        fits = df.limit(most + 1).count() <= most
    else:
        fits = (df.agg(F.sum(longs)).first()[0] or 0) <= most
    return F.broadcast(df) if fits else df


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
