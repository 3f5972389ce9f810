"""Embedding whitening: a two-pass covariance in tasks, its eigenvectors on the driver, a broadcast projection.

Vectors become whole numbers, each distinct one once. The first pass adds them up exactly,
which gives the mean; the second adds up outer products of centred vectors by matrix products
of blocks. Both are merged by treeAggregate, so that only one d x d matrix reaches the driver.
A third pass measures how far the whitened vectors' covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Steps of a unit, and what makes entries positive.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this, once scaled, count as this.
MOST = 1 << 62
COMPONENTS = 16
#: Rows of a block in tasks.
BLOCK = 4_096
#: Least share of the greatest eigenvalue that counts as variance.
TINY = 1e-12


class Whitening(NamedTuple):
    """n and sums of the fit list, eigenvalues from the greatest, and unit eigenvectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def quantised(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``vectors`` with x, an array of longs; rows whose vector is null or holds null, NaN or infinity are left out."""
    v = F.col(vector_col).cast("array<double>")
    usable = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    most = float(MOST)
    # A double of up to 2**62 becomes a long exactly; floor would give a decimal's range first.
    scaled: Callable[[Column], Column] = lambda c: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), c * SCALE))) + F.lit(SHIFT).cast("long")
    return vectors.where(usable).withColumn("x", F.transform(v, scaled))


def _blocks(column: pa.Array, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, int64 matrix) of each block of rows of a list column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    for at in range(0, len(flat), BLOCK):
        yield at, flat[at : at + BLOCK]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: as int64 where no number can overflow, else as Python's whole numbers."""
    far = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
    s = np.array(sums, object)
    if far * n + max(map(abs, sums)) < 1 << 62:
        return x * n - s.astype(np.int64)
    return x.astype(object) * n - s


def deviation(z: np.ndarray) -> list[int | None]:
    """Sum of squares of each row of whole numbers; null where a long can't hold it."""
    if z.dtype != object and z.shape[1] * int(np.abs(z).max(initial=0)) ** 2 < 1 << 63:
        return (z * z).sum(axis=1).tolist()
    return [t if (t := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in z]


def _merged(fit: DataFrame, d: int, block: Callable[[np.ndarray], list[np.ndarray]], kind: str) -> list | None:
    """Sums of ``block``'s arrays over all rows of ``fit`` (x): in each partition, then in a tree of tasks.

    kind: ``object`` for whole numbers, carried as text, else ``float64``.
    """

    def part(batches):
        total = None
        for batch in batches:
            for _, x in _blocks(batch.column(0), d):
                got = block(x)
                total = got if total is None else [p + q for p, q in zip(total, got, strict=True)]
        if total is not None:
            rows = [" ".join(map(str, t.ravel())).encode() if kind == "object" else t.astype(np.float64).tobytes() for t in total]
            yield pa.RecordBatch.from_arrays([pa.array([rows], pa.list_(pa.binary()))], ["sums"])

    def read(row):
        return [np.array([int(v) for v in bytes(b).split()], object) if kind == "object" else np.frombuffer(bytes(b)) for b in row[0]]

    def add(p, q):
        return q if p is None else p if q is None else [x + y for x, y in zip(p, q, strict=True)]

    return fit.mapInArrow(part, "sums array<binary>").rdd.treeAggregate(None, lambda p, row: add(p, read(row)), add, depth=3)


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``vectors`` (x, all of length d), each distinct one once; None without rows."""
    once = saved(vectors.select("x").distinct())
    first = _merged(once, d, lambda x: [np.array([len(x)], object), x.astype(object).sum(axis=0) if np.abs(x).max(initial=0) >= 1 << 40 else x.sum(axis=0).astype(object)], "object")
    if first is None:
        return None
    n, sums = int(first[0][0]), [int(s) for s in first[1]]

    def outer(x):
        c = centred(x, n, sums).astype(np.float64) / n
        return [c.T @ c]

    cov = _merged(once, d, outer, "float64")[0].reshape(d, d) / n
    values, vecs = np.linalg.eigh((cov + cov.T) / 2)
    values, vecs = np.maximum(values[::-1], 0.0)[:components], np.ascontiguousarray(vecs[:, ::-1][:, :components])
    made = Whitening(n, sums, values, vecs, float(np.trace(cov)), 0.0)
    live = int((values > TINY * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    if not live:
        return made

    def spread(x):
        w = projected(made, centred(x, n, sums))[:, :live]
        return [w.T @ w, w.sum(axis=0)]

    product, total = _merged(once, d, spread, "float64")
    mean = total / n
    apart = np.abs(product.reshape(live, live) / n - np.outer(mean, mean) - np.eye(live)).max()
    return made._replace(identity_error=float(apart))


def projected(w: Whitening, z: np.ndarray) -> np.ndarray:
    """Whitened rows of the exact ``centred`` numbers z; 0 in components without variance."""
    greatest = w.values[0] if len(w.values) else 0.0
    live = w.values > TINY * greatest
    scale = np.where(live, 1 / np.sqrt(np.where(live, w.values, 1.0)), 0.0)
    return (z.astype(np.float64) / w.n) @ (w.vectors * scale)


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Vectors of each length are a fit of their own; empty vectors have no components. Repeated
    rows are kept, and count once in the fit; ids may be null. Where all vectors of a length
    are equal, or fewer dimensions vary than there are components, the rest is 0.0. A deviation
    beyond a long is null. Other columns aren't looked at.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = quantised(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "vector").select("id", "x")
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = spark.createDataFrame([], schema)
    lengths = sorted(r[0] for r in rows.select(F.size("x").alias("d")).distinct().collect())
    for d in lengths:
        mine = rows.where(F.size("x") == d)
        model = fit(mine, d, components) if d else None
        if model is None:
            continue
        shared = spark.sparkContext.broadcast(model)

        def project(batches, d=d, shared=shared):
            w = shared.value
            m = len(w.values)
            share = w.values / w.trace if w.trace > 0 else np.zeros(m)
            for batch in batches:
                for at, x in _blocks(batch.column(1), d):
                    z = centred(x, w.n, w.sums)
                    n = len(x)
                    own = pa.array(np.repeat(np.arange(n), m))
                    cols = [
                        batch.column(0).slice(at, n).take(own), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), n)), pa.array(np.full(n * m, w.n)), pa.array(deviation(z), pa.int64()).take(own),
                        pa.array(projected(w, z).ravel()), pa.array(np.tile(share, n)), pa.array(np.full(n * m, w.identity_error)),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        out = out.unionByName(mine.mapInArrow(project, schema))
    return out.withColumnRenamed("id", id_col)
