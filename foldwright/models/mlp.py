"""Multilayer perceptron trained by synchronous AdamW mini-batches.

A step is one Spark job over its mini-batch, with the epoch's cosine step size; see ``models/synchronous.py``. Layers
are normalised by the rows of a block in a step (at most a chunk of it), as distributed training does. Dropout masks
come from seed, step and block, so a fit is repeatable and does not depend on the input's partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.functions.scalar import hash_unit
from foldwright.models.arrays import (
    list_column,
    matrix,
    vector,
    with_computed,
)
from foldwright.models.linear import class_predictions
from foldwright.models.synchronous import BLOCKS, HELD_OUT, STEPS, lay_out, packed, row_width, summed_step, target_scale
from foldwright.models.trees import _mix

VALIDATION_SHARE = 0.1
EARLY_STOP_ROWS = 100
IMPROVEMENT = 1e-6
#: Rows of a partition that makes dropout passes, and hidden units of the rows that pass at once, to stay in a core's cache.
DRAW_ROWS, DRAW_CELLS = 65_536, 65_536
_BN_EPS, _BN_KEEP = 1e-5, 0.9
_B1, _B2, _EPS = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class Shape:
    inputs: int
    outputs: int
    hidden: int
    layers: int
    dropout: float
    batch_norm: bool

    def sizes(self) -> list[tuple[str, tuple[int, ...]]]:
        out, width = [], self.inputs
        for i in range(self.layers):
            out += [(f"w{i}", (width, self.hidden)), (f"b{i}", (self.hidden,))]
            if self.batch_norm:
                out += [(f"g{i}", (self.hidden,)), (f"s{i}", (self.hidden,))]
            width = self.hidden
        return [*out, ("wo", (width, self.outputs)), ("bo", (self.outputs,))]

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, size in self.sizes():
            n = int(np.prod(size))
            out[name] = flat[at : at + n].reshape(size)
            at += n
        return out

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        parts = []
        for name, size in self.sizes():
            if name[0] == "w":
                bound = 1 / np.sqrt(size[0])
                parts.append(rng.uniform(-bound, bound, size).reshape(-1))
            else:
                parts.append(np.ones(size) if name[0] == "g" else np.zeros(size))
        return np.concatenate(parts)

    def stats(self) -> np.ndarray:
        """Running mean and variance of every normalised layer."""
        one = np.concatenate([np.zeros(self.hidden), np.ones(self.hidden)])
        return np.tile(one, self.layers) if self.batch_norm else np.zeros(0)


def forward(shape: Shape, p, stats, x, masks=None, training=False, start=0):
    """Outputs, and what the backward pass needs; x is the input of layer ``start``."""
    cache, new_stats, a = [], stats.copy(), x
    for i in range(start, shape.layers):
        z = a @ p[f"w{i}"] + p[f"b{i}"]
        norm = None
        if shape.batch_norm:
            at = slice(2 * i * shape.hidden, (2 * i + 1) * shape.hidden)
            bt = slice((2 * i + 1) * shape.hidden, (2 * i + 2) * shape.hidden)
            if training and len(z) > 1:
                mean, var = z.mean(axis=0), z.var(axis=0)
                new_stats[at] = _BN_KEEP * new_stats[at] + (1 - _BN_KEEP) * mean
                new_stats[bt] = _BN_KEEP * new_stats[bt] + (1 - _BN_KEEP) * var * len(z) / (len(z) - 1)
            else:
                mean, var = stats[at], stats[bt]
            inv = 1 / np.sqrt(var + _BN_EPS)
            unit = (z - mean) * inv
            norm = (unit, inv)
            z = unit * p[f"g{i}"] + p[f"s{i}"]
        h = np.maximum(z, 0)
        if masks is not None:
            h = h * masks[i]
        cache.append((a, z, norm))
        a = h
    return a @ p["wo"] + p["bo"], a, cache, new_stats


def backward(shape: Shape, p, x_last, cache, masks, grad_out) -> np.ndarray:
    g = {"wo": x_last.T @ grad_out, "bo": grad_out.sum(axis=0)}
    d = grad_out @ p["wo"].T
    for i in reversed(range(shape.layers)):
        a, z, norm = cache[i]
        if masks is not None:
            d = d * masks[i]
        d = d * (z > 0)
        if norm is not None:
            unit, inv = norm
            g[f"g{i}"], g[f"s{i}"] = (d * unit).sum(axis=0), d.sum(axis=0)
            d = d * p[f"g{i}"]
            d = inv * (d - d.mean(axis=0) - unit * (d * unit).mean(axis=0))
        g[f"w{i}"], g[f"b{i}"] = a.T @ d, d.sum(axis=0)
        d = d @ p[f"w{i}"].T
    return np.concatenate([g[name].reshape(-1) for name, _ in shape.sizes()])


def _loss(task: str, out: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed loss and its gradient with respect to the outputs (per row)."""
    if task == "regression":
        gap = out[:, 0] - y
        return float((gap * gap).sum()), 2 * gap[:, None]
    e = np.exp(out - out.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    rows = np.arange(len(y))
    loss = -np.log(np.maximum(p[rows, y.astype(int)], 1e-300)).sum()
    p[rows, y.astype(int)] -= 1
    return float(loss), p


def dropout_masks(shape: Shape, rows: int, rng: np.random.Generator) -> list[np.ndarray] | None:
    if shape.dropout <= 0:
        return None
    keep = 1 - shape.dropout
    return [(rng.random((rows, shape.hidden)) < keep) / keep for _ in range(shape.layers)]


def row_masks(shape: Shape, seed: int, hashes: np.ndarray, draw: int) -> list[np.ndarray] | None:
    """Masks of one dropout pass by seed, draw and each row's hash, whatever rows come with it."""
    if shape.dropout <= 0:
        return None
    keep = 1 - shape.dropout
    unit = np.arange(shape.hidden, dtype=np.int64)
    key = (hashes * np.int64(1_000_003) + np.int64(draw * 7919))[:, None] + unit[None, :] * np.int64(104_729)
    return [(_mix(key, seed * 101 + i + 1) < keep) / keep for i in range(shape.layers)]


def drawn_moments(shape: Shape, p, stats, x: np.ndarray, hashes: np.ndarray, seed: int, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of each row's first output over seeded dropout passes."""
    below = min(1, shape.layers)
    first = forward(replace(shape, layers=below), p, stats, x)[1]  # no mask comes before it
    found = np.empty((draws, len(x)))
    for draw in range(draws):
        masks = row_masks(shape, seed, hashes, draw)
        a = first * masks[0] if masks else first
        found[draw] = forward(shape, p, stats, a, masks, start=below)[0][:, 0]
    return found.mean(axis=0), found.var(axis=0)


@dataclass(frozen=True)
class MLPState:
    """Weights, running layer statistics, the optimiser's moments and how many steps were made."""

    weights: np.ndarray
    stats: np.ndarray
    m: np.ndarray
    v: np.ndarray
    step: float = 0.0

    @classmethod
    def start(cls, weights: np.ndarray, stats: np.ndarray) -> MLPState:
        return cls(weights, stats, np.zeros_like(weights), np.zeros_like(weights))


@dataclass
class MLP:
    """``steps`` mini-batches an epoch at every size of the table, summed over ``blocks``.

    With ``batch_size`` an epoch has as many steps as mini-batches of about that many rows need; a step is a job, so
    that is for tables of some thousand mini-batches at most.
    """

    task: str
    hidden_dim: int = 128
    n_layers: int = 2
    dropout: float = 0.1
    batch_norm: bool = True
    lr: float = 1e-3
    weight_decay: float = 1e-4
    batch_size: int | None = None
    steps: int = STEPS
    blocks: int = BLOCKS
    max_epochs: int = 100
    patience: int = 10
    classes: int = 2
    seed: int = 0

    def fit(self, train: DataFrame) -> MLPModel:
        n = train.count()
        early = n >= EARLY_STOP_ROWS
        steps = self.steps if self.batch_size is None else max(1, -(-n // self.batch_size))
        held_out = hash_unit(F.lit(f"mlp{self.seed}"), F.col("row_id")) < VALIDATION_SHARE if early else None
        data = packed(lay_out(train, steps, self.blocks, self.seed, held_out)).persist()
        try:
            scale = target_scale(data) if self.task == "regression" else (0.0, 1.0)
            outputs = 1 if self.task == "regression" else self.classes
            width = row_width(data)
            shape = Shape(width, outputs, self.hidden_dim, self.n_layers, self.dropout, self.batch_norm)
            best = self._train(data, shape, scale, early, steps)
        finally:
            data.unpersist()
        return MLPModel(self.task, shape, best.weights, best.stats, *scale, self.seed)

    def _train(self, data: DataFrame, shape: Shape, scale: tuple[float, float], early: bool, steps: int) -> MLPState:
        state = MLPState.start(shape.start(self.seed), shape.stats())
        best, best_loss, waited = state, np.inf, 0
        for epoch in range(self.max_epochs):
            rate = self.lr * (1 + np.cos(np.pi * epoch / self.max_epochs)) / 2
            for k in range(steps):
                state = self.step(data, k, shape, state, scale, rate)
            loss = self.validation_loss(data, shape, state, scale) if early else -np.inf
            if not early or loss < best_loss - IMPROVEMENT:
                best, best_loss, waited = state, max(loss, 0.0) if early else np.inf, 0
            else:
                waited += 1
                if waited >= self.patience:
                    break
        return best

    def contribution(self, shape: Shape, state: MLPState, x: np.ndarray, y: np.ndarray, draw: int = 0) -> np.ndarray:
        """Summed gradient and rows times the running statistics, for some rows; draw seeds their dropout masks."""
        rng = np.random.default_rng([self.seed, int(state.step), draw])
        masks = dropout_masks(shape, len(y), rng)
        p = shape.unpack(state.weights)
        out, last, cache, stats = forward(shape, p, state.stats, x, masks, True)
        grad = backward(shape, p, last, cache, masks, _loss(self.task, out, y)[1])
        return np.concatenate([grad, len(y) * stats])

    def step(self, laid_out: DataFrame, mini_batch: int, shape: Shape, state: MLPState, scale: tuple[float, float], rate: float) -> MLPState:
        """One AdamW move by a mini-batch's gradient."""
        rows, sums = summed_step(laid_out, mini_batch, lambda x, y, block: self.contribution(shape, state, x, (y - scale[0]) / scale[1], block))
        return state if not rows else self.move(state, sums[: state.weights.size] / rows, sums[state.weights.size :] / rows, rate)

    def move(self, state: MLPState, grad: np.ndarray, stats: np.ndarray, rate: float) -> MLPState:
        count = state.step + 1
        m = _B1 * state.m + (1 - _B1) * grad
        v = _B2 * state.v + (1 - _B2) * grad * grad
        step = (m / (1 - _B1**count)) / (np.sqrt(v / (1 - _B2**count)) + _EPS)
        return MLPState(state.weights - rate * (step + self.weight_decay * state.weights), stats, m, v, count)

    def validation_loss(self, laid_out: DataFrame, shape: Shape, state: MLPState, scale: tuple[float, float]) -> float:
        """Mean loss of the rows that are held out; infinite without any."""
        task, p = self.task, shape.unpack(state.weights)

        def judged(x: np.ndarray, y: np.ndarray, block: int) -> np.ndarray:
            return np.array([_loss(task, forward(shape, p, state.stats, x)[0], (y - scale[0]) / scale[1])[0]])

        rows, sums = summed_step(laid_out, HELD_OUT, judged)
        return sums[0] / rows if rows else np.inf


@dataclass
class MLPModel:
    task: str
    shape: Shape
    weights: np.ndarray
    stats: np.ndarray
    mean: float = 0.0
    std: float = 1.0
    seed: int = 0

    def predict(self, df: DataFrame) -> DataFrame:
        shape, w, stats, mean, std, task = (
            self.shape, self.weights, self.stats, self.mean, self.std, self.task)

        def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            out = forward(shape, shape.unpack(w), stats, matrix(batch))[0]
            if task == "regression":
                return {"pred": pa.array(out[:, 0] * std + mean)}
            e = np.exp(out - out.max(axis=1, keepdims=True))
            return {"proba": list_column(e / e.sum(axis=1, keepdims=True))}

        if task == "regression":
            return with_computed(df, compute, [T.StructField("pred", T.DoubleType())])
        proba = T.StructField("proba", T.ArrayType(T.DoubleType()))
        return class_predictions(with_computed(df, compute, [proba]))

    def predict_uncertainty(self, df: DataFrame, draws: int = 30) -> DataFrame:
        """(row_id, mean, std) over seeded dropout passes; normalisation stays fixed.

        Each row goes to Python once, dealt to as many partitions as the rows ask for, since a small file of many rows
        has few. Its passes are made there, with masks seeded by (seed, draw, row), and give its mean and variance;
        Spark merges those of rows with the same row_id.
        """
        shape, w, stats, y_mean, y_std, seed = (
            self.shape, self.weights, self.stats, self.mean, self.std, self.seed)
        cut = max(1, DRAW_CELLS // shape.hidden)

        def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            x, hashes, p = matrix(batch), vector(batch, "row_hash", np.int64), shape.unpack(w)
            parts = [drawn_moments(shape, p, stats, x[i : i + cut], hashes[i : i + cut], seed, draws) for i in range(0, max(1, len(x)), cut)]
            mean, var = (np.concatenate(part) for part in zip(*parts))
            return {"m": pa.array(mean * y_std + y_mean), "v": pa.array(var * y_std * y_std)}

        rows = df.select("row_id", "features")
        parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // DRAW_ROWS))
        dealt = rows.repartition(parts, "row_id").withColumn("row_hash", F.xxhash64("row_id"))
        fields = [T.StructField("m", T.DoubleType()), T.StructField("v", T.DoubleType())]
        scored = with_computed(dealt, compute, fields, drop=["features", "row_hash"])
        # every row has the same number of passes, so plain averages merge them
        return scored.groupBy("row_id").agg(F.avg("m").alias("mean"), F.sqrt(F.avg("v") + F.var_pop("m")).alias("std"))

    def state(self) -> dict:
        s = self.shape
        return {"kind": "mlp", "task": self.task, "weights": self.weights.tolist(),
                "stats": self.stats.tolist(), "mean": self.mean, "std": self.std, "seed": self.seed,
                "shape": [s.inputs, s.outputs, s.hidden, s.layers, s.dropout, s.batch_norm]}
