"""Radial-kernel machine by random Fourier features.

An approximation of the kernel model: seeded cosine features, then linear
support vectors one against the rest with sigmoid-scaled margins, or ridge for
regression. Linear in the number of rows. The cosine features are made anew in every
pass and never stored, so memory and disk hold the rows as they come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.models.arrays import (
    SMALL_ROWS,
    block_arrays,
    list_column,
    matrix,
    packed_rows,
    spread,
    summed_vectors,
    vector,
    with_computed,
)
from foldwright.models.linear import Ridge, class_predictions
from foldwright.operators.columns import TARGET


#: Rows whose cosines a task holds at once: few enough for them to stay in a core's cache from step to step.
CHUNK_ROWS = 256
#: Steps that the curvature is taken from, and trial steps of a line search.
MEMORY, SEARCH_STEPS = 10, 20
_TOLERANCE, _ARMIJO, _WOLFE = 1e-6, 1e-4, 0.9
_LAST_VALUES = 20

Spec = tuple[float, int, int, int]


def _waves(spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    gamma, size, seed, width = spec
    rng = np.random.default_rng([seed, width, size])
    w = rng.normal(scale=np.sqrt(2 * gamma), size=(width, size))
    return w, rng.uniform(0, 2 * np.pi, size)


def _mapped(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(2 / len(b)) * np.cos(x @ w + b)


def fourier_features(df: DataFrame, gamma: float, size: int, seed: int, width: int) -> DataFrame:
    """Replace ``features`` by sqrt(2/D) cos(xW + b), which approximates exp(-gamma |x - z|^2)."""
    w, b = _waves((gamma, size, seed, width))

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"features": list_column(_mapped(matrix(batch), w, b))}

    return with_computed(
        df, compute, [T.StructField("features", T.ArrayType(T.DoubleType()))], drop=["features"]
    )


def _with_margins(df: DataFrame, spec: Spec, weights: list[list[float]], name: str) -> DataFrame:
    """The margin by each of the weights (intercept first); the mapped features stay in the task."""
    w, b = _waves(spec)
    flat = np.asarray(weights, dtype=float)

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        x = matrix(batch)
        parts = [_mapped(x[i : i + CHUNK_ROWS], w, b) @ flat[:, 1:].T + flat[:, 0] for i in range(0, len(x), CHUNK_ROWS)]
        return {name: list_column(np.concatenate(parts) if parts else np.zeros((0, len(flat))))}

    return with_computed(df, compute, [T.StructField(name, T.ArrayType(T.DoubleType()))])


_BLOCK = {TARGET: np.float64, "features": np.float64}


def _packed(df: DataFrame) -> DataFrame:
    """Targets and features in packed blocks: no pass converts rows one by one."""
    return packed_rows(df.select(TARGET, "features"), lambda batch: {TARGET: vector(batch, TARGET), "features": matrix(batch)}, list(_BLOCK))


def _labelled_margins(blocks: DataFrame, spec: Spec, weights: list[float], positive: int) -> DataFrame:
    """(label, margin) of every row of packed blocks."""
    w, b = _waves(spec)
    flat = np.asarray(weights, dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (rows for batch in batches for rows in block_arrays(batch, _BLOCK, TARGET)):
            x = rows["features"]
            margin = np.concatenate([_mapped(x[i : i + CHUNK_ROWS], w, b) @ flat[1:] + flat[0] for i in range(0, len(x), CHUNK_ROWS)])
            yield pa.RecordBatch.from_pydict({"label": pa.array((rows[TARGET] == positive).astype(float)), "margin": pa.array(margin)})

    return blocks.mapInArrow(run, "label double, margin double")


def _summed(rows: DataFrame, spec: Spec, parts: int | None, contribution) -> np.ndarray:
    """Sum of contribution(mapped features, targets) over packed rows, which are mapped anew, a chunk at a time.

    The phase is taken modulo one turn, so that cosines of four bytes are as good as their seven digits.
    """
    w, b = _waves(spec)
    w, b = w / (2 * np.pi), b / (2 * np.pi)
    scale = np.sqrt(2 / len(b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in (block for batch in batches for block in block_arrays(batch, _BLOCK, TARGET)):
            all_x, all_y = block["features"], block[TARGET]
            for i in range(0, len(all_y), CHUNK_ROWS):
                turns = all_x[i : i + CHUNK_ROWS] @ w
                turns += b
                turns -= np.rint(turns)
                turns *= 2 * np.pi
                angles = turns.astype(np.float32)
                np.multiply(np.cos(angles, out=angles), scale, out=turns, dtype=float)
                part = contribution(turns, all_y[i : i + CHUNK_ROWS])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([list_column(total[None, :])], ["sums"])

    return summed_vectors(rows.select(TARGET, "features").mapInArrow(run, "sums array<double>"), parts)[0]


def _direction(grad: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the gradient times the inverse curvature of the last (step, change of gradient) pairs, downhill in each place."""
    d, shares = -grad, []
    for s, y in reversed(history):
        share = (s @ d) / (s @ y)
        shares.append(share)
        d = d - share * y
    if history:
        s, y = history[-1]
        d = d * ((s @ y) / (y @ y))
    for (s, y), share in zip(history, reversed(shares)):
        d = d + s * (share - (y @ d) / (s @ y))
    return np.where(d * grad < 0, d, 0.0)


def minimise(cost: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int, max_iter: int) -> np.ndarray:
    """Quasi-Newton minimum of cost(x) -> (value, gradient) from zero, with the memory, tolerance and limits of LinearSVC.

    A step keeps the signs of its start: a coordinate stops at zero and leaves it in the next step.
    """
    x = np.zeros(size)
    value, grad = cost(x)
    first, values, history = abs(value), [value], []
    for iteration in range(max_iter):
        if np.linalg.norm(grad) <= max(_TOLERANCE * abs(value), 1e-8):
            break
        d, sign = _direction(grad, history), np.where(x != 0, np.sign(x), -np.sign(grad))

        def ahead(step: float) -> tuple[float, np.ndarray, np.ndarray]:
            there = x + step * d
            there = np.where(np.sign(there) == sign, there, 0.0)
            return (*cost(there), there)

        step, slope = (0.5 / np.linalg.norm(grad) if not iteration else 1.0), grad @ d
        found = None
        for _ in range(SEARCH_STEPS):
            new_value, new_grad, there = ahead(step)
            now = new_grad @ d
            if new_value > value + step * slope * _ARMIJO:
                factor = 0.1 if not iteration else 0.5
            elif now < _WOLFE * slope:
                factor = 2.1
            elif abs(now) > _WOLFE * abs(slope):
                factor = 0.1 if not iteration else 0.5
            else:
                found = new_value, new_grad, there
                break
            step *= factor
        if found is None:
            if not history:
                break
            history = []
            continue
        change = found[2] - x, found[1] - grad
        if change[0] @ change[1] > 0:
            history = [*history, change][-MEMORY:]
        value, grad, x = found
        values = [*values, value][-_LAST_VALUES:]
        if abs(value - max(values)) <= _TOLERANCE * first:
            break
    return x


def hinge_weights(rows: DataFrame, spec: Spec, n: int, parts: int | None, positive: int, moments: tuple[np.ndarray, np.ndarray], C: float, max_iter: int) -> list[float]:
    """(intercept, coefficients...) of the linear support vector machine on the mapped features, one class against the rest.

    As LinearSVC without standardisation: it searches on standardised features, and the penalty counts the weights of
    the features as they are. No mapped feature is stored, each pass makes them again.
    """
    mean, std = moments
    inverse = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
    penalty = inverse * inverse / (C * n)

    def cost(v: np.ndarray) -> tuple[float, np.ndarray]:
        weights = v[:-1] * inverse
        intercept = v[-1] - weights @ mean

        def contribution(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            sign = np.where(y == positive, 1.0, -1.0)
            gap = 1.0 - sign * (x @ weights + intercept)
            push = np.where(gap > 0, -sign, 0.0)
            return np.concatenate([[np.maximum(gap, 0.0).sum(), push.sum()], push @ x])

        sums = _summed(rows, spec, parts, contribution) / n
        grad = np.append(inverse * (sums[2:] - mean * sums[1]) + penalty * v[:-1], sums[1])
        return sums[0] + 0.5 * penalty @ (v[:-1] * v[:-1]), grad

    v = minimise(cost, len(mean) + 1, max_iter)
    weights = v[:-1] * inverse
    return [float(v[-1] - weights @ mean), *map(float, weights)]


@dataclass
class KernelMachine:
    task: str
    C: float = 1.0
    gamma: float | str = "scale"
    components: int = 256
    classes: int = 2
    seed: int = 0
    max_iter: int = 50

    def _gamma(self, train: DataFrame, width: int) -> float:
        if self.gamma != "scale":
            return float(self.gamma)
        cells = train.select(F.explode("features").alias("v")).agg(F.var_pop("v")).first()[0]
        return 1.0 / (width * (cells or 1.0))

    def fit(self, train: DataFrame) -> KernelModel:
        width = len(train.select("features").first()[0])
        gamma = self._gamma(train, width)
        spec = (gamma, self.components, self.seed, width)
        narrow = train.select("row_id", TARGET, "features")
        if self.task == "regression":
            model = Ridge(alpha=1.0 / self.C).fit(fourier_features(narrow, *spec))
            return KernelModel(self.task, spec, [list(model.coefficients)], [])
        n = train.count()
        parts = 4 if n <= SMALL_ROWS else None
        rows = _packed(spread(narrow, n, parts=4)).persist()
        try:
            sums = _summed(rows, spec, parts, lambda x, y: np.concatenate([x.sum(axis=0), (x * x).sum(axis=0)]))
            mean, squares = np.split(sums / n, 2)
            std = np.sqrt(np.maximum(squares - mean * mean, 0.0) * n / max(n - 1, 1))
            wanted = [1] if self.classes == 2 else range(self.classes)
            margins, sigmoids = [], []
            for c in wanted:
                margins.append(hinge_weights(rows, spec, n, parts, c, (mean, std), self.C, self.max_iter))
                scaled = _labelled_margins(rows, spec, margins[-1], c).select(
                    "label", array_to_vector(F.array(-F.col("margin"), F.col("margin"))).alias("margins"))
                sigmoid = LogisticRegression(featuresCol="margins", maxIter=50).fit(scaled)
                # The margins are (-m, m): only the difference of their weights matters.
                a = sigmoid.coefficients[1] - sigmoid.coefficients[0]
                sigmoids.append((float(a), float(sigmoid.intercept)))
        finally:
            rows.unpersist()
        return KernelModel(self.task, spec, margins, sigmoids)


@dataclass
class KernelModel:
    task: str
    spec: Spec
    margins: list[list[float]]
    sigmoids: list[tuple[float, float]]

    def predict(self, df: DataFrame) -> DataFrame:
        scored = _with_margins(df, self.spec, self.margins, "_m")
        if self.task == "regression":
            return scored.withColumn("pred", F.get("_m", F.lit(0))).drop("_m")
        scores = [1 / (1 + F.exp(-(F.lit(a) * F.get("_m", F.lit(i)) + F.lit(b)))) for i, (a, b) in enumerate(self.sigmoids)]
        if len(scores) == 1:
            scored = scored.withColumn("_p", scores[0])
            proba = F.array(1 - F.col("_p"), F.col("_p"))
        else:
            scored = scored.withColumn("_p", F.array(*scores))
            total = F.greatest(F.aggregate("_p", F.lit(0.0), lambda a, b: a + b), F.lit(1e-300))
            proba = F.transform("_p", lambda s: s / total)
        out = scored.select(*df.columns, proba.alias("proba"))
        return class_predictions(out)

    def state(self) -> dict:
        return {"kind": "kernel", "task": self.task, "spec": list(self.spec),
                "margins": [list(map(float, m)) for m in self.margins],
                "sigmoids": [list(s) for s in self.sigmoids]}
