"""Feature selection over the ``features`` array: which positions to keep."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.models.linear import Lasso
from foldwright.models.logistic import Logistic, LogisticModel
from foldwright.models.trees import ExtraTrees
from foldwright.operators.columns import TARGET
from foldwright.operators.ordering import quantile_table, with_cuts_below

STRATEGIES = ("none", "filter", "l1", "tree", "rfe")
MI_BINS = 32
COEFFICIENT_FLOOR = 1e-5
LASSO_ALPHA = 0.01
LOGISTIC_C = 0.1
TREE_COUNT = 50
RFE_TREES = 25
RFE_STEP = 0.2


def keep_positions(df: DataFrame, kept: Sequence[int]) -> DataFrame:
    """Reduce ``features`` to the kept positions."""
    picked = F.transform(F.array(*[F.lit(int(i)) for i in kept]), lambda i: F.get("features", i))
    return df.withColumn("features", picked)


def _long(df: DataFrame, *extra: Column | str) -> DataFrame:
    """(extra..., feature, value) rows of the feature array."""
    return df.select(*extra, F.posexplode("features").alias("feature", "value"))


def variances(df: DataFrame) -> DataFrame:
    """(feature, variance), pre-aggregated before the shuffle."""
    return _long(df).groupBy("feature").agg(F.var_pop("value").alias("variance"))


def nonconstant(df: DataFrame) -> list[int]:
    rows = variances(df).filter("variance > 0").select("feature").collect()
    return sorted(r["feature"] for r in rows)


def mutual_information(df: DataFrame, task: str, bins: int = MI_BINS) -> DataFrame:
    """(feature, mi): information between binned feature and target.

    Equal-frequency bins instead of a nearest-neighbour estimator: the numbers
    differ, the purpose (a ranking of features) is the same. A regression
    target is binned too.
    """
    probs = [i / bins for i in range(1, bins)]
    values = _long(df, F.lit(1).cast("long").alias("n"))
    edges = quantile_table(values, ["feature"], "value", ["n"], probs).groupBy("feature").agg(
        F.array_sort(F.collect_set("quantile")).alias("edges")
    )
    if task == "regression":
        ys = df.select(F.lit(0).alias("g"), F.col(TARGET).cast("double").alias("value"), F.lit(1).cast("long").alias("n"))
        y_edges = quantile_table(ys, ["g"], "value", ["n"], probs).agg(
            F.array_sort(F.collect_set("quantile"))
        ).first()[0]
        df = df.withColumns({"_edges": F.array(*[F.lit(v) for v in y_edges]), "_y": F.col(TARGET).cast("double")})
        df = with_cuts_below(df, "y", "_edges", "_y", bins - 1)
    else:
        df = df.withColumn("y", F.col(TARGET).cast("int"))
    # One row of cut points per feature column: bounded by the schema.
    placed = with_cuts_below(_long(df, "y").join(F.broadcast(edges), "feature"), "b", "edges", "value", bins - 1)
    cells = placed.groupBy("feature", "b", "y").agg(F.count(F.lit(1)).alias("n"))
    # At most bins x max(bins, classes) cells per feature.
    each = Window.partitionBy("feature")
    joint = cells.select(
        "feature",
        F.col("n"),
        F.sum("n").over(each).alias("total"),
        F.sum("n").over(Window.partitionBy("feature", "b")).alias("nb"),
        F.sum("n").over(Window.partitionBy("feature", "y")).alias("ny"),
    )
    p = F.col("n") / F.col("total")
    return joint.groupBy("feature").agg(
        F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("nb") * F.col("ny")))).alias("mi")
    )


def top_percentile(scores: DataFrame, score: str, percentile: float) -> DataFrame:
    """Rows whose score reaches the (100 - percentile) percentile; scores are one row per feature."""
    cut = scores.agg(F.percentile(score, 1 - percentile / 100)).scalar()
    return scores.filter(F.col(score) >= cut)


def by_information(df: DataFrame, task: str, percentile: int = 50) -> list[int]:
    varying = nonconstant(df)
    if not varying:
        return []
    scores = mutual_information(keep_positions(df, varying), task)
    kept = top_percentile(scores, "mi", percentile).collect()
    return sorted(varying[r["feature"]] for r in kept)


def by_l1(df: DataFrame, task: str, classes: int = 2) -> list[int]:
    """Positions with a non-zero coefficient of an L1-penalised linear model."""
    if task == "regression":
        w = np.abs(np.asarray(Lasso(LASSO_ALPHA).fit(df).coefficients[1:]))
    else:
        fitted = Logistic(C=LOGISTIC_C, classes=classes, l1=True).fit(df)
        w = (
            fitted.magnitudes if isinstance(fitted, LogisticModel)
            else np.abs(fitted.model.coefficientMatrix.toArray()).sum(axis=0)
        )
    return [int(i) for i in np.flatnonzero(w > COEFFICIENT_FLOOR)]


def by_tree(df: DataFrame, task: str, classes: int, seed: int, trees: int = TREE_COUNT) -> list[int]:
    """Positions whose extra-trees importance reaches the median."""
    model = ExtraTrees(task, n_estimators=trees, max_depth=6, classes=classes, seed=seed).fit(df)
    importance = np.asarray(model.importances)
    return [int(i) for i in np.flatnonzero(importance >= np.median(importance))]


def by_elimination(
    df: DataFrame, task: str, classes: int, seed: int, fraction: float = 0.5, trees: int = RFE_TREES
) -> list[int]:
    """Drop a fifth of the original features per round until ``fraction`` of them is left."""
    width = len(df.select("features").first()[0])
    goal, step = max(1, int(width * fraction)), max(1, int(width * RFE_STEP))
    kept = list(range(width))
    forest = ExtraTrees(task, n_estimators=trees, max_depth=6, classes=classes, seed=seed)
    # Bins are those of a feature by itself: they are the same in every round.
    edges, data = forest.bin(df)
    try:
        while len(kept) > goal:
            order = np.argsort(np.asarray(forest.grow(data, edges, kept).importances), kind="stable")
            drop = set(order[: min(step, len(kept) - goal)].tolist())
            kept = [k for i, k in enumerate(kept) if i not in drop]
    finally:
        data.unpersist()
    return kept


def select_features(
    df: DataFrame,
    strategy: str,
    task: str,
    classes: int = 2,
    percentile: int = 50,
    n_features_fraction: float = 0.5,
    seed: int = 0,
) -> list[int] | None:
    """Kept positions, or None for all. At least one feature stays."""
    if strategy == "none":
        return None
    if strategy == "filter":
        kept = by_information(df, task, percentile)
    elif strategy == "l1":
        kept = by_l1(df, task, classes)
    elif strategy == "tree":
        kept = by_tree(df, task, classes, seed)
    elif strategy == "rfe":
        kept = by_elimination(df, task, classes, seed, n_features_fraction)
    else:
        raise ValueError(f"no selection strategy {strategy!r}; strategies: {', '.join(STRATEGIES)}")
    return kept or [0]
