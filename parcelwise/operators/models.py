"""Linear and kernel regressions: one pass over the rows, small solves on d x d numbers.

Only sums, Gram matrices and bandwidth scores reach the driver; their size depends on the
number of features, not of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def feature_columns(df: DataFrame, prefix: str = "FF") -> list[str]:
    return sorted(c for c in df.columns if c.startswith(prefix))


@dataclass
class Model:
    features: list[str]
    scale: list[float]
    coef: list[float]
    intercept: float
    kind: str = "ols"
    excluded: list[str] = field(default_factory=list)

    def frame(self, spark) -> DataFrame:
        """One row of named arrays, to be written as Parquet."""
        return spark.createDataFrame([(self.kind, self.features, self.scale, self.coef, self.intercept, self.excluded)], "kind string, features array<string>, scale array<double>, coef array<double>, intercept double, excluded array<string>")

    @staticmethod
    def read(df: DataFrame) -> Model:
        r = df.first()
        return Model(list(r["features"]), list(r["scale"]), list(r["coef"]), r["intercept"], r["kind"], list(r["excluded"]))


def usable(df: DataFrame, features: list[str]) -> tuple[list[str], list[float], list[str]]:
    """(kept, their maxima, excluded): columns whose sum is about 0 go. One aggregate."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise KeyError(f"features {missing} are absent")
    r = df.agg(*(F.sum(f).alias(f"s{i}") for i, f in enumerate(features)), *(F.max(f).alias(f"m{i}") for i, f in enumerate(features))).first()
    keep = [i for i in range(len(features)) if abs(r[f"s{i}"] or 0.0) >= 1e-10]
    return [features[i] for i in keep], [float(r[f"m{i}"]) or 1.0 for i in keep], [f for i, f in enumerate(features) if i not in keep]


def gram(df: DataFrame, features: list[str], scale: list[float], target: str) -> np.ndarray:
    """Gram matrix of (1, x / scale, y), by partial sums of map tasks."""
    d = len(features) + 2
    scales = np.array(scale)

    def partial(batches):
        total = np.zeros((d, d))
        for pdf in batches:
            x = pdf.to_numpy(float)
            z = np.concatenate([np.ones((len(x), 1)), x[:, :-1] / scales, x[:, -1:]], 1)
            total += z.T @ z
        yield pd.DataFrame({"k": range(d * d), "v": total.ravel()})

    rows = df.select(*(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)), F.col(target).cast("double").alias("y")).na.drop()
    parts = rows.mapInPandas(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(d * d)
    for r in parts:
        out[r["k"]] = r["v"]
    return out.reshape(d, d)


@dataclass
class Preparation:
    """A fitted transform of features: over their maxima, by weights, and turned to principal components.

    centre and rotation (features x components) are empty without components.
    """

    features: list[str]
    scale: list[float]
    centre: list[float] = field(default_factory=list)
    rotation: list[list[float]] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)

    def columns(self) -> list[Column]:
        """The transformed features as Columns p0, p1, ...; null where a feature is null."""
        scaled = [F.col(f).cast("double") / F.lit(s) for f, s in zip(self.features, self.scale, strict=True)]
        if not self.rotation:
            return [c.alias(f"p{i}") for i, c in enumerate(scaled)]
        moved = [c - F.lit(m) for c, m in zip(scaled, self.centre, strict=True)]
        return [reduce(lambda a, b: a + b, (c * F.lit(r[k]) for c, r in zip(moved, self.rotation, strict=True))).alias(f"p{k}") for k in range(len(self.rotation[0]))]

    def model(self, coef: np.ndarray, intercept: float, kind: str) -> Model:
        """A linear model of the transformed features as one of the features themselves."""
        if self.rotation:
            coef = np.array(self.rotation) @ coef
            intercept = intercept - float(np.array(self.centre) @ coef)
        return Model(self.features, self.scale, [float(c) for c in coef], float(intercept), kind, self.excluded)


def prepare(df: DataFrame, features: list[str], weights: dict[str, float] | None = None, pca: bool | float = False) -> Preparation:
    """The transform of ``features``: columns that add up to about 0 go, the rest is divided by its maximum.

    weights: factors of features, 1 where none is given; a factor of 0 leaves a feature out. pca: True for all principal
    components, or the share of variance that they must explain. The components' Gram matrix is one pass.
    """
    keep, scale, out = usable(df, features)
    weighed = [(f, s / weights.get(f, 1.0)) for f, s in zip(keep, scale, strict=True) if weights.get(f, 1.0)] if weights else list(zip(keep, scale, strict=True))
    names, scales = [f for f, _ in weighed], [s for _, s in weighed]
    prep = Preparation(names, scales, excluded=out + [f for f in keep if f not in names])
    if pca is False or not names:
        return prep
    values, vectors, mean = _components(df, names, scales)
    if pca is not True:
        m = int(np.searchsorted(np.cumsum(values) / values.sum(), float(pca) - 1e-12)) + 1
        vectors = vectors[:, :m]
    return Preparation(names, scales, mean.tolist(), vectors.tolist(), prep.excluded)


def _prepared_gram(df: DataFrame, prep: Preparation, target: str) -> np.ndarray:
    rows = df.select(*prep.columns(), F.col(target).alias("y"))
    names = rows.columns[:-1]
    return gram(rows, names, [1.0] * len(names), "y")


def fit_ols(df: DataFrame, features: list[str], target: str, weights: dict[str, float] | None = None, pca: bool | float = False) -> Model:
    """Least squares with intercept; collinear columns get the solution of least norm.

    weights, pca: see ``prepare``. With all components the model is that without.
    """
    prep = prepare(df, features, weights, pca)
    g = _prepared_gram(df, prep, target)
    x = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]
    return prep.model(x[1:], float(x[0]), "ols")


#: A weight whose precision passes this share of its column's information has been ruled out.
RULED_OUT = 1e8


def fit_ard(df: DataFrame, features: list[str], target: str, rounds: int = 100, settled: float = 1e-4, weights: dict[str, float] | None = None, pca: bool | float = False) -> Model:
    """Sparse Bayesian weights by evidence maximisation on the Gram matrix; the rows are read once.

    MacKay's fixed point: a weight's precision becomes the share of it that the data determine,
    over its square; the noise's becomes the free rows over the squared residual. Weights whose
    precision runs away are ruled out and stay 0. It ends when no precision moves by more than
    ``settled`` of itself. The intercept is a weight like others. weights, pca: see ``prepare``; with
    components it is those that are ruled out.
    """
    prep = prepare(df, features, weights, pca)
    g = _prepared_gram(df, prep, target)
    n, a, b, yy = g[0, 0], g[:-1, :-1], g[:-1, -1], g[-1, -1]
    weight = np.zeros(len(b))
    if n and yy > 0:
        information = np.maximum(np.diag(a), 1e-300)
        noise, precision, live = 10 * n / yy, np.full(len(b), n / yy), np.ones(len(b), bool)
        for _ in range(rounds):
            at = np.ix_(live, live)
            spread = np.linalg.inv(noise * a[at] + np.diag(precision[live]))
            mean = noise * spread @ b[live]
            determined = np.clip(1 - precision[live] * np.diag(spread), 1e-12, 1)
            left = max(yy - 2 * mean @ b[live] + mean @ a[at] @ mean, 1e-12 * yy)
            fresh, before = determined / np.maximum(mean**2, 1e-300), precision[live]
            weight = np.zeros(len(b))
            weight[live] = mean
            noise = max(n - determined.sum(), 1e-6 * n) / left
            precision[live] = fresh
            live = live & (precision < RULED_OUT * noise * information)
            if not live.any() or np.all(np.abs(fresh - before) <= settled * before):
                break
        weight = np.where(live, weight, 0.0)
    return prep.model(weight[1:], float(weight[0]), "ard")


def _components(df: DataFrame, features: list[str], scale: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors, means) of the scaled features' covariance, descending; a vector's largest entry is positive."""
    g = gram(df, features, scale, features[0])
    n, mean = g[0, 0], g[0, 1:-1] / g[0, 0]
    cov = (g[1:-1, 1:-1] - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values, vectors * sign, mean


def principal(df: DataFrame, features: list[str], explained: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, rotation) of the scaled features' covariance, descending; cut at a share of the variance."""
    keep, scale, _ = usable(df, features)
    values, vectors, _ = _components(df, keep, scale)
    if explained is not None:
        m = int(np.searchsorted(np.cumsum(values) / values.sum(), explained)) + 1
        values, vectors = values[:m], vectors[:, :m]
    return values, vectors


def apply_linear(df: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """A Column dot product, scaled as in the fit."""
    missing = [f for f in model.features if f not in df.columns]
    if missing:
        raise KeyError(f"features {missing} are absent")
    out = F.lit(model.intercept)
    for f, s, c in zip(model.features, model.scale, model.coef, strict=True):
        out = out + F.col(f) * F.lit(c / s)
    return df.withColumn(name, out)


#: Rows of a block of training or query rows: so many times the features, in doubles, are in one row of a table.
BLOCK_ROWS = 1_000


def _packed(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(name): blocks of at most BLOCK_ROWS rows, each the columns as doubles, row by row."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK_ROWS):
                yield pd.DataFrame({name: [pdf.iloc[at : at + BLOCK_ROWS].to_numpy(float).ravel()]})

    return df.select(*(F.col(c).cast("double").alias(c) for c in columns)).mapInPandas(run, f"{name} array<double>")


def _merged(training: DataFrame, names: list[str]) -> DataFrame:
    """(names, n, total): training rows of equal features as one, with their number and the sum of their targets."""
    return training.groupBy(*names).agg(F.count("target").alias("n"), F.sum("target").alias("total"))


def _weighed(q: np.ndarray, t: np.ndarray, sigmas: list[float]) -> np.ndarray:
    """(sigmas, 2, queries): sums of weights and of weighted targets of query rows against merged training rows (features, n, total)."""
    out = np.empty((len(sigmas), 2, len(q)))
    for at in range(0, len(q), 128):
        d = sum(np.abs(q[at : at + 128, None, i] - t[None, :, i]) for i in range(q.shape[1])) + np.zeros((1, len(t)))
        for k, s in enumerate(sigmas):
            out[k, :, at : at + 128] = (np.exp(-d / s) @ t[:, -2:]).T
    return out


@dataclass
class KernelModel:
    """A general regression: the transform, the bandwidth, and the table of transformed training rows (p0, ..., target)."""

    preparation: Preparation
    sigma: float
    training: DataFrame

    def save(self, path: str) -> None:
        """Parquet below ``path``: one row of named arrays, and the training rows."""
        p = self.preparation
        row = [("general", p.features, p.scale, p.centre, p.rotation, p.excluded, self.sigma)]
        kind = "kind string, features array<string>, scale array<double>, centre array<double>, rotation array<array<double>>, excluded array<string>, sigma double"
        self.training.sparkSession.createDataFrame(row, kind).write.mode("overwrite").parquet(f"{path}/model")
        self.training.write.mode("overwrite").parquet(f"{path}/training")

    @staticmethod
    def load(spark: SparkSession, path: str) -> KernelModel:
        r = spark.read.parquet(f"{path}/model").first()
        prep = Preparation(list(r["features"]), list(r["scale"]), list(r["centre"]), [list(x) for x in r["rotation"]], list(r["excluded"]))
        return KernelModel(prep, r["sigma"], spark.read.parquet(f"{path}/training"))


def fit_general(df: DataFrame, features: list[str], target: str, sigma: float | None = None, weights: dict[str, float] | None = None, pca: bool | float = False) -> KernelModel:
    """A general regression of all training rows without nulls; the bandwidth of least error unless it is given. weights, pca: see ``prepare``."""
    prep = prepare(df, features, weights, pca)
    training = df.select(*prep.columns(), F.col(target).cast("double").alias("target")).na.drop()
    return KernelModel(prep, bandwidth_of(training) if sigma is None else sigma, training)


def score_general(df: DataFrame, model: KernelModel, key: str, name: str = "score") -> DataFrame:
    """(key, score): kernel mean of the training targets, weights exp(-L1 / sigma) between transformed features.

    Rows of equal features are one, on both sides, with the number and the sum of the targets of the training
    rows. Query rows meet all training rows, both in blocks, and the sums of a query's blocks are added
    up, so neither side passes through the driver or one task. Null if all weights are 0 or a
    feature is null; repeated keys are one row's worth each.
    """
    missing = [f for f in model.preparation.features if f not in df.columns]
    if missing:
        raise KeyError(f"features {missing} are absent")
    columns = model.preparation.columns()
    names, width, sigma = [f"p{i}" for i in range(len(columns))], len(columns), model.sigma
    rows = df.dropDuplicates([key]).select(F.col(key), *(c.cast("double").alias(f"p{i}") for i, c in enumerate(columns)))
    known = _packed(_merged(model.training, names), [*names, "n", "total"], "t")
    asked = _packed(rows.select(*names).na.drop().distinct(), names, "q")

    def run(batches):
        for pdf in batches:
            for x, y in zip(pdf["q"], pdf["t"], strict=True):
                q = np.reshape(x, (-1, width))
                w, wy = _weighed(q, np.reshape(y, (-1, width + 2)), [sigma])[0]
                yield pd.DataFrame({**{n: q[:, i] for i, n in enumerate(names)}, "w": w, "wy": wy})

    sums = asked.crossJoin(known).mapInPandas(run, ", ".join(f"{n} double" for n in (*names, "w", "wy")))
    scores = sums.groupBy(*names).agg(F.try_divide(F.sum("wy"), F.sum("w")).alias(name))
    return rows.join(scores, names, "left").select(key, name)


def apply_general(df: DataFrame, training: DataFrame, features: list[str], target: str, sigma: float, key: str, name: str = "score") -> DataFrame:
    """``score_general`` by a model of ``training`` with the given bandwidth; training rows with nulls take no part."""
    return score_general(df, fit_general(training, features, target, sigma), key, name)


def bandwidth_errors(training: DataFrame, sigmas: list[float], most: int | None = None) -> dict[float, float]:
    """Mean absolute error of general regression by sigma over transformed ``training`` rows (p0, ..., target).

    An example's own target is taken out of the weighted sum, while its weight stays in the denominator.
    All rows are examples unless ``most`` is given: then it is every n-th training row by a hash of the row,
    ``most`` or about so many (a documented sample, for the search of a bandwidth). Each meets all training
    rows; rows of equal features are one there, and examples of equal features and target too.
    """
    names = [c for c in training.columns if c != "target"]
    n, width = training.count(), len(names)
    if not n:
        return dict.fromkeys(sigmas, float("nan"))
    step = 1 if most is None else max(n // most, 1)
    examples = training if step == 1 else training.where(F.pmod(F.xxhash64(*names, "target"), F.lit(step)) == 0)
    examples = examples.groupBy(*names, "target").agg(F.count(F.lit(1)).alias("copies"))
    known = _packed(_merged(training, names), [*names, "n", "total"], "t")
    asked = _packed(examples.select(*names).distinct(), names, "q")

    def run(batches):
        for pdf in batches:
            for x, y in zip(pdf["q"], pdf["t"], strict=True):
                q = np.reshape(x, (-1, width))
                for s, (w, wy) in zip(sigmas, _weighed(q, np.reshape(y, (-1, width + 2)), sigmas), strict=True):
                    yield pd.DataFrame({"sigma": s, **{n: q[:, i] for i, n in enumerate(names)}, "w": w, "wy": wy})

    sums = asked.crossJoin(known).mapInPandas(run, ", ".join(f"{n} double" for n in ("sigma", *names, "w", "wy")))
    per = sums.groupBy("sigma", *names).agg(F.sum("w").alias("w"), F.sum("wy").alias("wy")).join(examples, names)
    error = F.abs(F.try_divide(F.col("wy") - F.col("target"), F.col("w")) - F.col("target"))
    mean = F.try_divide(F.sum(error * F.col("copies")), F.sum(F.when(error.isNotNull(), F.col("copies"))))
    return {r["sigma"]: r["e"] for r in per.groupBy("sigma").agg(mean.alias("e")).collect()}


def bandwidth_error(training: DataFrame, features: list[str], target: str, sigmas: list[float], most: int | None = None) -> dict[float, float]:
    """``bandwidth_errors`` of features over their maxima."""
    return bandwidth_errors(fit_general(training, features, target, 1.0).training, sigmas, most)


#: Examples of the bandwidth search, or about so many.
EXAMPLES = 1_000


def bandwidth_of(training: DataFrame, low: float = 0.01, high: float = 1.0, rounds: int = 4, points: int = 8) -> float:
    """The sigma of least error over EXAMPLES examples: a grid of ``points`` from low to high in one pass, then finer around the best, ``rounds`` times.

    Where the best is an end of the first grid the span moves on past it, at most three times.
    """
    best, moved = low, 0
    while rounds > 0:
        grid = np.exp(np.linspace(np.log(low), np.log(high), points)).tolist()
        error = bandwidth_errors(training, grid, EXAMPLES)
        at = min(range(points), key=lambda i: (error.get(grid[i], np.inf), i))
        best = grid[at]
        if moved < 3 and at in (0, points - 1) and high / low > 10:
            low, high, moved = (best / 100, best * 2, moved + 1) if at == 0 else (best / 2, best * 100, moved + 1)
            continue
        low, high, rounds = grid[max(0, at - 1)], grid[min(points - 1, at + 1)], rounds - 1
    return best


def bandwidth(training: DataFrame, features: list[str], target: str, low: float = 0.01, high: float = 1.0, rounds: int = 4, points: int = 8) -> float:
    """``bandwidth_of`` features over their maxima."""
    return bandwidth_of(fit_general(training, features, target, 1.0).training, low, high, rounds, points)
