"""Exact k-nearest-neighbour join in bounded blocks, and the votes on top of it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.models.linear import class_predictions
from foldwright.operators.columns import TARGET

BLOCK_ROWS = 5_000
MAX_K = 50
#: Blocks of a side up to LARGEST_BLOCK rows each: a row is copied once for each block of the other side.
GRID = 12
LARGEST_BLOCK = 32_768
#: Rough distances, and candidates, that a task holds at once.
_CELLS, _HITS = 4_000_000, 50_000


def _blocks(rows: int, block_rows: int) -> int:
    """Blocks of ``block_rows`` rows, at most GRID of them as long as none has more than LARGEST_BLOCK rows."""
    return max(1, -(-rows // max(block_rows, min(LARGEST_BLOCK, -(-rows // GRID)))))


def _nearest_in_block(x: np.ndarray, z: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k rows of x nearest to each of z, by query, distance and row."""
    x_norm = (x * x).sum(axis=1)
    m, most = min(k, len(x)), x_norm.max()
    found = []
    chunk = max(1, _CELLS // len(x))
    for start in range(0, len(z), chunk):
        part = z[start : start + chunk]
        rough = part @ (-2 * x.T)
        rough += x_norm
        # The k-th smallest rough distance bounds the candidates, with slack for rounding.
        bound = np.partition(rough, m - 1, axis=1)[:, m - 1] + 1e-9 * (1 + most + (part * part).sum(axis=1))
        query, row = np.nonzero(rough <= bound[:, None])
        # Whole queries at a time, as many as stay below _HITS candidates.
        ends = np.searchsorted(query, np.arange(len(part)), side="right")
        at = first = 0
        while at < len(part):
            upto = max(at + 1, int(np.searchsorted(ends, first + _HITS, side="right")))
            q, r = query[first : ends[upto - 1]], row[first : ends[upto - 1]]
            exact = np.sqrt(((x[r] - part[q]) ** 2).sum(axis=1))
            order = np.lexsort((r, exact, q))
            place = np.arange(len(q)) - np.searchsorted(q, q)
            best = order[place < k]
            found.append((q[best] + start, r[best], exact[best]))
            at, first = upto, ends[upto - 1]
    return tuple(np.concatenate(columns) for columns in zip(*found))


def neighbour_table(
    train: DataFrame,
    queries: DataFrame,
    k: int = MAX_K,
    block_rows: int = BLOCK_ROWS,
    n_train: int | None = None,
    n_queries: int | None = None,
) -> DataFrame:
    """(query_id, train_id, distance, y, rn): the k nearest training rows per query.

    Both sides are cut into hash blocks of a bounded size, ``block_rows`` on
    small tables, so that a row is copied a few times only; every pair of blocks
    meets in one task, which keeps the k best candidates per query, and the
    candidates of all training blocks are merged. Exact: no block is skipped.
    Ties in distance go to the smaller key.
    """
    n_train = train.count() if n_train is None else n_train
    n_queries = queries.count() if n_queries is None else n_queries
    t_blocks, q_blocks = _blocks(n_train, block_rows), _blocks(n_queries, block_rows)

    def block(n: int):
        return F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int")

    left = train.select(
        F.col("row_id").alias("train_id"),
        F.col(TARGET).cast("double").alias("y"),
        F.col("features").alias("train_features"),
        block(t_blocks).alias("tb"),
        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"),
    )
    right = queries.select(
        F.col("row_id").alias("query_id"),
        F.col("features").alias("query_features"),
        block(q_blocks).alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(t_blocks - 1))).alias("tb"),
    )

    def nearest(t: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "train_id", "distance", "y"]
        if t.empty or q.empty:
            return pd.DataFrame({c: [] for c in columns})
        order = np.argsort(t["train_id"].to_numpy(dtype=str), kind="stable")
        x = np.stack(t["train_features"].to_numpy())[order]
        ids, y = t["train_id"].to_numpy()[order], t["y"].to_numpy()[order]
        z, names = np.stack(q["query_features"].to_numpy()), q["query_id"].to_numpy()
        at, hit, distance = _nearest_in_block(x, z, k)
        return pd.DataFrame({"query_id": names[at], "train_id": ids[hit], "distance": distance, "y": y[hit]})

    candidates = left.groupBy("tb", "qb").cogroup(right.groupBy("tb", "qb")).applyInPandas(
        nearest, "query_id string, train_id string, distance double, y double"
    )
    # At most k candidates per query and training block reach this window.
    best = Window.partitionBy("query_id").orderBy("distance", "train_id")
    return candidates.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k)


def vote(neighbours: DataFrame, k: int, weights: str, task: str, classes: int = 2) -> DataFrame:
    """(query_id, pred[, proba]) for one candidate (k, weights) from a shared neighbour table.

    With distance weights an exact match outvotes everything else.
    """
    near = neighbours.filter(F.col("rn") <= k)
    if weights == "distance":
        exact = F.sum((F.col("distance") == 0).cast("int")).over(Window.partitionBy("query_id"))
        near = near.withColumn("_exact", exact).withColumn(
            "w",
            F.when(F.col("_exact") > 0, (F.col("distance") == 0).cast("double")).otherwise(
                1 / F.col("distance")
            ),
        )
    else:
        near = near.withColumn("w", F.lit(1.0))
    by_query = near.groupBy("query_id")
    if task == "regression":
        return by_query.agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("pred"))
    shares = F.array(
        *[F.sum(F.when(F.col("y") == c, F.col("w")).otherwise(0.0)) / F.sum("w") for c in range(classes)]
    )
    return class_predictions(by_query.agg(shares.alias("proba")))


@dataclass
class KNN:
    task: str
    n_neighbors: int = 5
    weights: str = "uniform"
    classes: int = 2

    def fit(self, train: DataFrame) -> KNNModel:
        return KNNModel(self, train.select("row_id", TARGET, "features"))


@dataclass
class KNNModel:
    spec: KNN
    train: DataFrame

    def predict(self, df: DataFrame) -> DataFrame:
        s = self.spec
        table = neighbour_table(self.train, df, s.n_neighbors)
        votes = vote(table, s.n_neighbors, s.weights, s.task, s.classes)
        return df.join(votes.withColumnRenamed("query_id", "row_id"), "row_id")

    def state(self) -> dict:
        return {"kind": "knn", "task": self.spec.task, "n_neighbors": self.spec.n_neighbors,
                "weights": self.spec.weights, "classes": self.spec.classes}
