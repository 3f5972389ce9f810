"""Approximate nearest neighbours by score-aware (anisotropic) product quantisation.

Vectors of length one are cut into short subspaces of 16 centroids each. Codebooks and
codes lessen a loss that weighs the part of the residual parallel to the vector more
than the rest, as that part is what moves large inner products. A block of vectors is
scanned with tables of four-bit codes, two codes a byte; the best of each block are
reranked by the exact cosine of the original vectors, in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

#: Vectors that the codebooks are fitted on at most: those of the least hash.
SAMPLE_ROWS = 10_000
#: Dimensions of a subspace.
STEP = 2
#: Inner products of at least this share of the norm are to be kept apart; sets the loss's weight.
THRESHOLD = 0.2
ROUNDS = 8
#: Rows scanned at a time, and how many of them are reranked for a query at least.
BLOCK = 8192
RERANK = 96
#: Queries that go to the executors at a time.
QUERY_BLOCK = 4096


class Codebook:
    def __init__(self, sample: np.ndarray, rounds: int = ROUNDS, seed: int = 11):
        d = sample.shape[1]
        self.dim = d
        self.parts = -(-d // STEP)
        if self.parts % 2:
            self.parts += 1
        self.weight = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        x = self.cut(sample)
        draw = np.random.default_rng(seed)
        pick = draw.integers(0, len(x), (16, self.parts))
        self.centre = np.stack([x[pick[:, m], m] for m in range(self.parts)])  # part, code, step
        self.centre += draw.normal(0, 1e-3, self.centre.shape)
        for _ in range(rounds):
            code = self.encode(sample)
            self.update(x, code)

    def cut(self, unit: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(unit), self.parts * STEP))
        wide[:, : unit.shape[1]] = unit
        return wide.reshape(len(unit), self.parts, STEP)

    def encode(self, unit: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on |r|^2 + (weight - 1) (r.x)^2."""
        x = self.cut(unit)
        dist = np.stack([((x[:, m, None] - self.centre[m]) ** 2).sum(-1) for m in range(self.parts)], 1)
        along = np.stack([(x[:, m] ** 2).sum(-1)[:, None] - x[:, m] @ self.centre[m].T for m in range(self.parts)], 1)
        code = dist.argmin(-1)
        rows = np.arange(len(x))
        total = along[rows[:, None], np.arange(self.parts), code].sum(1)
        for _ in range(sweeps):
            for m in range(self.parts):
                rest = total - along[rows, m, code[:, m]]
                loss = dist[:, m] + (self.weight - 1) * (rest[:, None] + along[:, m]) ** 2
                code[:, m] = loss.argmin(-1)
                total = rest + along[rows, m, code[:, m]]
        return code.astype(np.uint8)

    def update(self, x: np.ndarray, code: np.ndarray) -> None:
        """Centroids that least squares gives for the loss with the other parts held."""
        w = self.weight - 1
        along = np.stack([(x[:, m] * (x[:, m] - self.centre[m][code[:, m]])).sum(-1) for m in range(self.parts)], 1)
        total = along.sum(1)
        for m in range(self.parts):
            own = x[:, m]
            rest = total - along[:, m]
            for k in range(16):
                hit = code[:, m] == k
                if hit.any():
                    v = own[hit]
                    left = hit.sum() * np.eye(STEP) + w * v.T @ v
                    right = v.sum(0) + w * (v * (rest[hit] + (v * v).sum(-1))[:, None]).sum(0)
                    self.centre[m, k] = np.linalg.solve(left, right)
            along[:, m] = (own * (own - self.centre[m][code[:, m]])).sum(-1)
            total = rest + along[:, m]

    def pack(self, code: np.ndarray) -> np.ndarray:
        return code[:, 0::2] | (code[:, 1::2] << 4)

    def decode(self, packed: np.ndarray) -> np.ndarray:
        code = np.empty((len(packed), self.parts), np.uint8)
        code[:, 0::2], code[:, 1::2] = packed & 15, packed >> 4
        return self.centre[np.arange(self.parts), code].reshape(len(packed), -1)[:, : self.dim]

    def tables(self, query: np.ndarray) -> np.ndarray:
        """For each pair of parts the 256 sums of two centroids' inner products with the query."""
        one = np.einsum("mkd,md->mk", self.centre, self.cut(query[None])[0])
        return (one[1::2, :, None] + one[0::2, None, :]).reshape(self.parts // 2, 256).astype(np.float32)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) without null ids, and without vectors that are null, empty, zero, or hold
    null or non-finite components. Vectors whose squares would
    overflow or vanish are brought to a largest component of 1, which leaves their cosines."""
    v = F.col(vector_col).cast("array<double>")
    square = F.aggregate(v, F.lit(0.0), lambda a, b: a + b * b)
    most = F.array_max(F.transform(v, F.abs))
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), square.alias("s"), most.alias("most")).where("vec_id is not null and s is not null and most > 0 and most < double('Infinity')")
    fair = F.when(F.col("s").between(1e-200, 1e200), F.col("v")).otherwise(F.transform("v", lambda x: x / F.col("most")))
    return good.select("vec_id", fair.alias("v"), F.size("v").alias("dim"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query by cosine, its own id excepted.

    Equal vectors stand in the index once, with their ``k + 1`` least ids, which is all
    that a result can show of them; ties go to the smaller id. Vectors meet those of their own
    length, each length with an index of its own. Where a block's scan ends
    in a tie, or within the index's own error of it, all of those are reranked.
    """
    spark = vectors.sparkSession
    every, asked = saved(usable(vectors, id_col, vector_col)), saved(usable(queries, id_col, vector_col))
    lengths = sorted(r[0] for r in asked.select("dim").distinct().join(every.select("dim").distinct(), "dim").collect())
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim in lengths:
        own, mine = (t.where(F.col("dim") == dim).select("vec_id", "v") for t in (every, asked))
        found = found.unionByName(_searched(own, mine, dim, k, sample_rows, rerank))
    return found


def _searched(every: DataFrame, wanted: DataFrame, dim: int, k: int, sample_rows: int, rerank: int) -> DataFrame:
    """``search`` among vectors (vec_id, v) of one length."""
    hashed = every.withColumn("h", F.xxhash64("v"))
    least = hashed.withColumn("r", F.row_number().over(W.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    distinct = saved(least.select("vec_id", "v", "r", "h").repartition("h").sortWithinPartitions("h", "vec_id"))
    sample = distinct.where("r = 1").orderBy("h", "vec_id").limit(sample_rows).select("v").toArrow()
    x = _matrix(sample.column("v"), dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = Codebook(x)
    error = float(np.std(((x - book.decode(book.pack(book.encode(x)))) * np.roll(x, 1, axis=0)).sum(1)))
    parts = []
    # Queries go out in blocks; each block is one scan of the index.
    n_queries = wanted.count()
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    wanted = wanted.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    index = saved(encoded(distinct, book, dim))
    for b in range(blocks):
        block = wanted.where(F.col("b") == b).select("vec_id", "v").dropDuplicates().toArrow()
        ids, q = block.column("vec_id").to_numpy(), _matrix(block.column("v"), dim)
        parts.append(scan(index, book, ids, q, dim, k, rerank, 2 * error))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def encoded(distinct: DataFrame, book: Codebook, dim: int) -> DataFrame:
    """The index: every row with its codes, two to a byte."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dim)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                codes = book.pack(book.encode(x))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "v", "codes"])

    return distinct.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, codes binary")


def scan(index: DataFrame, book: Codebook, ids: np.ndarray, q: np.ndarray, dim: int, k: int, rerank: int, slack: float) -> DataFrame:
    """The best ``k`` of each block of the index for each query, reranked exactly."""
    norm = np.sqrt((q * q).sum(1))

    def run(batches):
        held: list[pa.RecordBatch] = []

        def best(table):
            own, v = table.column("vec_id").to_numpy(), _matrix(table.column("v"), dim)
            packed = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(own), -1)
            size = np.sqrt((v * v).sum(1))
            flat = packed.astype(np.int32) + 256 * np.arange(packed.shape[1], dtype=np.int32)
            out = [[], [], [], []]
            for i in range(len(ids)):
                rough = np.take(book.tables(q[i] / norm[i]).ravel(), flat).sum(1)
                if len(rough) > rerank:
                    bar = np.partition(rough, len(rough) - rerank)[len(rough) - rerank]
                    near = np.flatnonzero(rough >= bar - slack)
                else:
                    near = np.arange(len(rough))
                near = near[own[near] != ids[i]]
                score = (v[near] * q[i]).sum(1) / (size[near] * norm[i])
                top = np.lexsort((own[near], -score))[:k]
                out[0] += [int(ids[i])] * len(top)
                out[1] += [i] * len(top)
                out[2] += own[near][top].tolist()
                out[3] += score[top].tolist()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())], ["query_id", "q", "vec_id", "score"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                if sum(b.num_rows for b in held) >= BLOCK:
                    yield best(pa.Table.from_batches(held))
                    held = []
        if sum(b.num_rows for b in held):
            yield best(pa.Table.from_batches(held))

    return index.mapInArrow(run, "query_id long, q int, vec_id long, score double")
