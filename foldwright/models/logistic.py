"""Penalised logistic regression by Newton steps, one Spark job per step.

Each job sums loss, gradient and curvature over the rows; the step is algebra on
those sums. A handful of jobs reach the optimum where first-order methods take
hundreds. Very wide problems go to MLlib instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.models.arrays import list_column, matrix, spread, summed_vectors, vector
from foldwright.models.linear import MLlibLogistic, class_predictions, linear_expression
from foldwright.operators.columns import TARGET

NEWTON_LIMIT = 400  # parameters; the curvature matrix has the square of it
_ROWS_PER_PART = 50_000


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """[loss, gradient..., curvature...] of one block; w has one row per output."""
    z = np.column_stack([np.ones(len(x)), x])
    score = z @ w.T
    k, p = w.shape
    if k == 1:
        s = score[:, 0]
        loss = np.logaddexp(0, s).sum() - (y * s).sum()
        prob = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
        grad = z.T @ (prob - y)
        curve = z.T @ (z * (prob * (1 - prob))[:, None])
        return np.concatenate([[loss], grad, curve.reshape(-1)])
    score -= score.max(axis=1, keepdims=True)
    e = np.exp(score)
    prob = e / e.sum(axis=1, keepdims=True)
    rows = np.arange(len(y))
    loss = -np.log(np.maximum(prob[rows, y.astype(int)], 1e-300)).sum()
    gap = prob.copy()
    gap[rows, y.astype(int)] -= 1
    curve = np.empty((k, p, k, p))
    for a in range(k):
        for b in range(a, k):
            weight = prob[:, a] * ((a == b) - prob[:, b])
            curve[a, :, b, :] = curve[b, :, a, :] = z.T @ (z * weight[:, None])
    return np.concatenate([[loss], (gap.T @ z).reshape(-1), curve.reshape(-1)])


def _descend(w0, grad, curve, penalty, free, sweeps=500):
    """L1-penalised quadratic model around w0 by coordinate descent."""
    w, g = w0.copy(), grad.copy()  # g is the model's gradient at w
    for _ in range(sweeps):
        largest = 0.0
        for j in range(len(w)):
            h = curve[j, j]
            if h <= 1e-14:
                continue
            aim = w[j] - g[j] / h
            new = aim if free[j] else np.sign(aim) * max(abs(aim) - penalty / h, 0.0)
            move = new - w[j]
            if move:
                g += curve[:, j] * move
                w[j] = new
                largest = max(largest, abs(move))
        if largest < 1e-9:
            break
    return w


@dataclass
class Logistic:
    """Strength C as in C * sum(loss) + penalty; the intercept is not penalised."""

    C: float = 1.0
    classes: int = 2
    l1: bool = False
    max_steps: int = 50
    tol: float = 1e-8

    def fit(self, train: DataFrame):
        n = train.count()
        data = spread(train.select("row_id", TARGET, "features"), n, parts=1 + n // _ROWS_PER_PART).persist()
        try:
            width = len(data.select("features").first()[0])
            k = 1 if self.classes == 2 else self.classes
            if k * (width + 1) > NEWTON_LIMIT:
                return MLlibLogistic(self.C, l1=self.l1).fit(data)
            return LogisticModel(self._solve(data, n, k, width + 1).tolist())
        finally:
            data.unpersist()

    def _job(self, data: DataFrame, w: np.ndarray, parts: int | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    part = _sums(matrix(b), vector(b, TARGET), w)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([list_column(total[None, :])], ["sums"])

        frame = data.select(TARGET, "features").mapInArrow(run, "sums array<double>")
        return summed_vectors(frame, parts)[0]

    def _solve(self, data: DataFrame, n: int, k: int, p: int) -> np.ndarray:
        parts = (1 + n // _ROWS_PER_PART) if n <= 2_000_000 else None
        penalty = 1.0 / (self.C * n)
        free = np.zeros((k, p), dtype=bool)
        free[:, 0] = True
        free = free.reshape(-1)
        size = k * p

        def cost(loss: float, w: np.ndarray) -> float:
            held = w[~free]
            return loss / n + (penalty * np.abs(held).sum() if self.l1 else penalty / 2 * held @ held)

        w = np.zeros(size)
        found = self._job(data, w.reshape(k, p), parts)
        value = cost(found[0], w)
        for _ in range(self.max_steps):
            grad, curve = found[1 : 1 + size] / n, found[1 + size :].reshape(size, size) / n
            # Softmax has one flat direction per feature; a tiny ridge fixes it.
            curve = curve + 1e-10 * np.eye(size)
            if self.l1:
                aim = _descend(w, grad, curve, penalty, free)
            else:
                reg = np.where(free, 0.0, penalty)
                aim = w - np.linalg.lstsq(curve + np.diag(reg), grad + reg * w, rcond=None)[0]
            step, moved = aim - w, False
            for _ in range(20):
                trial = self._job(data, (w + step).reshape(k, p), parts)
                if cost(trial[0], w + step) <= value + 1e-12:
                    moved = True
                    break
                step = step / 2
            if not moved:
                break
            w, found, last = w + step, trial, value
            value = cost(found[0], w)
            if np.abs(step).max() < self.tol * (1 + np.abs(w).max()) or last - value < 1e-12:
                break
        return w.reshape(k, p)


@dataclass
class LogisticModel:
    weights: list[list[float]]

    @property
    def magnitudes(self) -> np.ndarray:
        """Summed absolute coefficients per feature."""
        return np.abs(np.asarray(self.weights)[:, 1:]).sum(axis=0)

    def predict(self, df: DataFrame) -> DataFrame:
        if len(self.weights) == 1:
            scored = df.withColumn("_p", 1 / (1 + F.exp(-linear_expression(self.weights[0]))))
            return class_predictions(
                scored.withColumn("proba", F.array(1 - F.col("_p"), F.col("_p"))).drop("_p"))
        scored = df.withColumn("_s", F.array(*[linear_expression(w) for w in self.weights]))
        top = F.array_max("_s")
        e = scored.withColumn("_s", F.transform("_s", lambda s: F.exp(s - top)))
        total = F.aggregate("_s", F.lit(0.0), lambda a, b: a + b)
        return class_predictions(
            e.withColumn("proba", F.transform("_s", lambda s: s / total)).drop("_s"))

    def state(self) -> dict:
        return {"kind": "newton_logistic", "weights": self.weights}
