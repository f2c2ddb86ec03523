"""Stochastic gradient descent by synchronous mini-batches, and incremental updates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.models.linear import class_predictions, linear_expression
from foldwright.models.synchronous import BLOCKS, STEPS, lay_out, packed, row_width, summed_step, target_scale

_L1_SHARE = {"l2": 0.0, "l1": 1.0, "elasticnet": 0.15}


@dataclass(frozen=True)
class SGDState:
    """Weights (one row per output: intercept first), the next step's number and the last epoch's mean loss."""

    weights: np.ndarray
    steps: float = 1.0
    loss: float = np.inf


def contribution(task: str, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Summed loss and its gradient (one row per output, intercept first) over some rows."""
    z = np.column_stack([np.ones(len(y)), x])
    score = z @ w.T
    if task == "regression":
        gap = score - y[:, None]
        loss, error = float((gap * gap).sum()) / 2, np.clip(gap, -1e3, 1e3)
    else:
        goal = y[:, None] if len(w) == 1 else (y[:, None] == np.arange(len(w))[None, :])
        score = np.clip(score, -35, 35)
        loss = float((np.logaddexp(0, score) - goal * score).sum())
        error = 1.0 / (1.0 + np.exp(-score)) - goal
    return np.concatenate([[loss], (error.T @ z).reshape(-1)])


@dataclass
class SGD:
    """Linear model by ``steps`` mini-batches an epoch, summed over ``blocks``; see ``models/synchronous.py``.

    An epoch sees every row once. A step has the size eta0 / number ** 0.25; the penalty acts after it, not on the
    intercept. Training ends after ``epochs``, or when ``patience`` epochs in a row have not lowered the mean loss by
    ``tol``. Neither the input's partitions nor the number of rows changes the rule.
    """

    task: str
    alpha: float = 1e-4
    penalty: str = "l2"
    epochs: int = 25
    steps: int = STEPS
    blocks: int = BLOCKS
    eta0: float = 0.3
    classes: int = 2
    seed: int = 0
    tol: float = 1e-3
    patience: int = 3

    def start(self, width: int) -> SGDState:
        outputs = 1 if self.task == "regression" or self.classes == 2 else self.classes
        return SGDState(np.zeros((outputs, width + 1)))

    def step(self, state: SGDState, rows: float, sums: np.ndarray) -> SGDState:
        """The move by the summed loss and gradient of a mini-batch."""
        share = _L1_SHARE[self.penalty]
        rate = self.eta0 / state.steps**0.25
        w = state.weights - rate * sums[1:].reshape(state.weights.shape) / rows
        shrink = rate * self.alpha
        w[:, 1:] *= 1 - min(1.0, shrink * (1 - share))
        if share:
            w[:, 1:] = np.sign(w[:, 1:]) * np.maximum(np.abs(w[:, 1:]) - shrink * share, 0)
        return SGDState(w, state.steps + 1, state.loss)

    def epoch(self, laid_out: DataFrame, state: SGDState, centre: float = 0.0, scale: float = 1.0) -> SGDState:
        """One pass over rows that lay_out has dealt; its state has the mean loss before the steps."""
        task, n, loss = self.task, 0.0, 0.0
        for k in range(self.steps):
            w = state.weights
            rows, sums = summed_step(laid_out, k, lambda x, y, block, w=w: contribution(task, w, x, (y - centre) / scale))
            if rows:
                n, loss = n + rows, loss + sums[0]
                state = self.step(state, rows, sums)
        return SGDState(state.weights, state.steps, loss / n if n else np.inf)

    def lay_out(self, df: DataFrame) -> DataFrame:
        return lay_out(df, self.steps, self.blocks, self.seed)

    def partial_fit(self, batch: DataFrame, state: SGDState | None) -> SGDState:
        """One pass over one bounded batch (out-of-core training)."""
        data = self.lay_out(batch).persist()
        try:
            return self.epoch(data, state or self.start(len(data.select("features").first()[0])))
        finally:
            data.unpersist()

    def fit(self, train: DataFrame) -> SGDModel:
        data = packed(self.lay_out(train)).persist()
        try:
            centre, scale = target_scale(data) if self.task == "regression" else (0.0, 1.0)
            state, best, waited = self.start(row_width(data)), np.inf, 0
            for _ in range(self.epochs):
                state = self.epoch(data, state, centre, scale)
                waited = 0 if state.loss <= best - self.tol else waited + 1
                best = min(best, state.loss)
                if waited >= self.patience:
                    break
        finally:
            data.unpersist()
        w = state.weights * scale
        w[:, 0] += centre
        return SGDModel(self.task, w)


@dataclass
class SGDModel:
    task: str
    weights: np.ndarray

    def predict(self, df: DataFrame) -> DataFrame:
        if self.task == "regression":
            return df.withColumn("pred", linear_expression(self.weights[0]))
        sigmoids = [1 / (1 + F.exp(-linear_expression(w))) for w in self.weights]
        if len(sigmoids) == 1:
            proba = F.array(1 - sigmoids[0], sigmoids[0])
            return class_predictions(df.withColumn("proba", proba))
        raw = df.withColumn("_s", F.array(*sigmoids))
        total = F.aggregate("_s", F.lit(0.0), lambda a, b: a + b)
        proba = F.transform("_s", lambda s: s / total)
        return class_predictions(raw.withColumn("proba", proba).drop("_s"))

    def state(self) -> dict:
        return {"kind": "sgd", "task": self.task, "weights": self.weights.tolist()}


