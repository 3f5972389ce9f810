"""Stable shards by jump consistent hashing.

A key's shard depends on the key and the number of shards alone; one more shard takes
the fraction of keys that it must hold, and no other key moves. There is no table of
ring positions to keep.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, text_or_empty

#: Rows of one (shard, bucket) whose slots one window counts, about.
BUCKET_ROWS = 50_000
#: Multiplier of the published generator.
_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, by the published jump recurrence, vectorised."""
    key = keys.astype(np.uint64, copy=True)
    at, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = ahead[live]
        key[live] = key[live] * _STEP + np.uint64(1)
        draw = ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[live] = ((at[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def assign(rows: DataFrame, key: str, shards: int, columns: tuple[str, str] = ("shard", "grown_shard")) -> DataFrame:
    """``rows`` (no text) with the shard of the long column ``key``, and with one more shard."""
    names = [f.name for f in rows.schema]

    def run(batches):
        for batch in batches:
            keys = batch.column(names.index(key)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(jump(keys, shards), pa.int32()), pa.array(jump(keys, shards + 1), pa.int32())], [*names, *columns])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, `{columns[0]}` int, `{columns[1]}` int")


def sharded(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law ``key``, shard, slot, grown_shard.

    size: UTF-8 bytes plus 1. slot: gapless from 0 in each shard. A null id's key is its
    text's checksum. Rows that repeat an id share its shard and have a slot each.
    """
    text = F.encode(text_or_empty(text_col), "UTF-8")
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32"))
    rows = rows.withColumn("key", F.when(F.col("id").isNull(), F.xxhash64(F.lit("null"), "text_crc32")).otherwise(F.xxhash64("id")))
    placed = saved(assign(rows, "key", shards))
    buckets = max(1, placed.count() // (BUCKET_ROWS * shards))
    dealt = placed.withColumn("bucket", F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(buckets)))
    inside = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")) - 1
    before = F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    base = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    out = dealt.withColumn("inside", inside).join(base, ["shard", "bucket"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("inside")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = 100_000) -> None:
    """Writes ``docs`` as Parquet, one folder ``shard=N`` each, without a shuffle of texts.

    Shards are those of ``sharded``: a null id's key is its text's checksum, so that such rows spread.
    A column that is itself called shard is written as __shard. An empty table writes no folder.
    """
    text = F.encode(text_or_empty(text_col), "UTF-8")
    key = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("null"), F.crc32(text).cast("long"))).otherwise(F.xxhash64(id_col))
    rows = docs.withColumn("__key", key)
    if "shard" in rows.columns:
        rows = rows.withColumnRenamed("shard", "__shard")
    picked = assign(rows, "__key", shards, ("shard", "__grown"))
    picked.drop("__key", "__grown").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
