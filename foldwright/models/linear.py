"""Linear models: ridge and lasso from one Gram aggregate; MLlib classifiers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.models.arrays import matrix, spread, vector
from foldwright.operators.columns import TARGET

_FLAT_SUM_LIMIT = 200


def gram_cells(df: DataFrame) -> DataFrame:
    """Summed products (fold, i, j, v), i <= j, of the columns (1, features, target).

    One pass for every fold: each partition emits its partial products, Spark
    sums them. Without a ``fold`` column there is one fold, -1.
    """
    keyed = df if "fold" in df.columns else df.withColumn("fold", F.lit(-1))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = matrix(batch), vector(batch, TARGET)
            z = np.column_stack([np.ones(len(y)), x, y])
            folds = vector(batch, "fold", int)
            for f in np.unique(folds):
                part = z[folds == f]
                g = part.T @ part
                sums[f] = sums[f] + g if f in sums else g
        for f, g in sums.items():
            i, j = np.triu_indices(g.shape[0])
            yield pa.RecordBatch.from_pydict(
                {
                    "fold": pa.array(np.full(i.size, f, dtype=np.int32)),
                    "i": pa.array(i.astype(np.int32)),
                    "j": pa.array(j.astype(np.int32)),
                    "v": pa.array(g[i, j]),
                }
            )

    partials = keyed.select("fold", TARGET, "features").mapInArrow(
        partial, "fold int, i int, j int, v double"
    )
    return partials.groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))


def gram_by_fold(df: DataFrame) -> dict[int, np.ndarray]:
    """Gram matrices per fold: (d + 2)^2 numbers each, bounded by the columns."""
    cells: dict[int, list] = {}
    for r in gram_cells(df).collect():
        cells.setdefault(r["fold"], []).append((r["i"], r["j"], r["v"]))
    out = {}
    for fold, rows in cells.items():
        size = max(j for _, j, _ in rows) + 1
        g = np.zeros((size, size))
        for i, j, v in rows:
            g[i, j] = g[j, i] = v
        out[fold] = g
    return out


def training_gram(grams: dict[int, np.ndarray], test_fold: int) -> np.ndarray:
    """Gram of a training set: the sum over the other folds."""
    return sum(g for f, g in grams.items() if f != test_fold)


def rescaled_gram(g: np.ndarray, center: Sequence[float], scale: Sequence[float]) -> np.ndarray:
    """Gram of the columns (1, (x - center) / scale, y) from that of (1, x, y)."""
    d = len(center)
    t = np.eye(d + 2)
    for j in range(d):
        t[j + 1, j + 1] = 1 / scale[j]
        t[j + 1, 0] = -center[j] / scale[j]
    return t @ g @ t.T


def raw_coefficients(w: np.ndarray, center: Sequence[float], scale: Sequence[float]) -> np.ndarray:
    """Coefficients on the unscaled features."""
    slopes = np.asarray(w[1:]) / np.asarray(scale)
    return np.concatenate([[w[0] - slopes @ np.asarray(center)], slopes])


def _centred(g: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray]:
    n = g[0, 0]
    x_mean, y_mean = g[0, 1:-1] / n, g[0, -1] / n
    sxx = g[1:-1, 1:-1] - n * np.outer(x_mean, x_mean)
    sxy = g[1:-1, -1] - n * x_mean * y_mean
    return n, x_mean, y_mean, sxx, sxy


def ridge_solution(g: np.ndarray, alpha: float) -> np.ndarray:
    """(intercept, coefficients...) of ridge with an unpenalised intercept."""
    _, x_mean, y_mean, sxx, sxy = _centred(g)
    w = np.linalg.lstsq(sxx + alpha * np.eye(len(sxy)), sxy, rcond=None)[0]
    return np.concatenate([[y_mean - x_mean @ w], w])


def lasso_solution(g: np.ndarray, alpha: float, max_iter: int = 5000, tol: float = 1e-10) -> np.ndarray:
    """Coordinate descent on the Gram: min 1/(2n) |y - Xw|^2 + alpha |w|_1."""
    n, x_mean, y_mean, sxx, sxy = _centred(g)
    q, c = sxx / n, sxy / n
    w = np.zeros(len(c))
    for _ in range(max_iter):
        largest = 0.0
        for j in range(len(c)):
            if q[j, j] <= 0:
                continue
            rho = c[j] - q[j] @ w + q[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / q[j, j]
            largest = max(largest, abs(new - w[j]))
            w[j] = new
        if largest < tol:
            break
    return np.concatenate([[y_mean - x_mean @ w], w])


def linear_expression(coefficients: Sequence[float], features: str = "features") -> Column:
    """intercept + features . w"""
    w = [float(v) for v in coefficients]
    if len(w) <= _FLAT_SUM_LIMIT:
        total = F.lit(w[0])
        for i, v in enumerate(w[1:]):
            if v != 0.0:
                total = total + F.get(features, F.lit(i)) * F.lit(v)
        return total
    weights = F.array(*[F.lit(v) for v in w[1:]])
    return F.aggregate(F.zip_with(features, weights, lambda a, b: a * b), F.lit(w[0]), lambda a, b: a + b)


def fold_predictions(df: DataFrame, coefficients: dict[int, np.ndarray]) -> DataFrame:
    """Test predictions of every fold: each row is scored by the model of its own fold."""
    pred = F.lit(None).cast("double")
    for fold, w in coefficients.items():
        pred = F.when(F.col("fold") == fold, linear_expression(w)).otherwise(pred)
    return df.withColumn("pred", pred)


@dataclass
class LinearModel:
    """Fitted linear regression (ridge, lasso or SGD)."""

    coefficients: list[float]

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("pred", linear_expression(self.coefficients))

    def state(self) -> dict:
        return {"kind": "linear", "coefficients": list(map(float, self.coefficients))}


@dataclass
class Ridge:
    alpha: float = 1.0

    def fit(self, train: DataFrame) -> LinearModel:
        (g,) = gram_by_fold(train.drop("fold")).values()
        return LinearModel(list(ridge_solution(g, self.alpha)))


@dataclass
class Lasso:
    alpha: float = 1.0
    max_iter: int = 5000

    def fit(self, train: DataFrame) -> LinearModel:
        (g,) = gram_by_fold(train.drop("fold")).values()
        return LinearModel(list(lasso_solution(g, self.alpha, self.max_iter)))


def class_predictions(df: DataFrame) -> DataFrame:
    """Add pred = argmax of proba (first on ties)."""
    from foldwright.functions.scalar import argmax

    return df.withColumn("pred", argmax(F.col("proba")))


@dataclass
class VectorModel:
    """An MLlib classifier whose probability vector becomes ``proba``."""

    model: object
    kind: str

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(df.withColumn("_v", array_to_vector("features")))
        out = scored.select(*df.columns, vector_to_array("probability").alias("proba"))
        return class_predictions(out)

    def state(self) -> dict:
        return {"kind": self.kind, "mllib": True}


@dataclass
class MLlibLogistic:
    """Penalised logistic regression with strength C, as regParam = 1 / (C n), for wide tables."""

    C: float = 1.0
    max_iter: int = 200
    l1: bool = False
    tol: float = 1e-6

    def fit(self, train: DataFrame) -> VectorModel:
        n = train.count()
        # Few, large partitions: an iteration over a small table is all task overhead.
        vectors = spread(train, n, parts=1 + n // 200_000).select(
            F.col(TARGET).cast("double").alias("label"), array_to_vector("features").alias("_v")
        ).persist()
        try:
            model = LogisticRegression(
                featuresCol="_v",
                regParam=1.0 / (self.C * n),
                elasticNetParam=1.0 if self.l1 else 0.0,
                standardization=False,
                maxIter=self.max_iter,
                tol=self.tol,
            ).fit(vectors)
        finally:
            vectors.unpersist()
        return VectorModel(model, "logistic")
