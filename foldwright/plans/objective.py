"""The objective of a search: all trials of a batch are scored together on each step's training and validation rows.

What trials share is computed once. Trials with the same preprocessing share its fit and the prepared rows. Ridge and
lasso need no rows beyond that: the Gram blocks of the two sides, summed in one job, give every trial's coefficients
and its validation error by algebra. Nearest-neighbour trials vote on one table of neighbours, and boosting trials that
differ in their number of rounds only are prefixes of the longest. Whatever is left is fitted trial by trial; the
predictions of all trials are scored in one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.models.linear import gram_by_fold, lasso_solution, ridge_solution
from foldwright.models.neighbours import MAX_K, neighbour_table, vote
from foldwright.models.zoo import build_model
from foldwright.operators import metrics
from foldwright.operators.columns import TARGET, split_columns
from foldwright.operators.preprocess import Preprocessor
from foldwright.operators.selection import keep_positions, select_features
from foldwright.plans.pipeline import params_part

Trial = tuple[int, Mapping[str, object]]
#: Parameter that counts a booster's rounds.
ROUNDS = {"hist_gb": "model.max_iter", "xgboost": "model.n_estimators"}
DEFAULT_ROUNDS = {"hist_gb": 100, "xgboost": 300}
PARALLEL_GROUPS = 4


def gram_rmse(train: np.ndarray, validation: np.ndarray, coefficients: np.ndarray) -> float:
    """Root mean squared error on the rows of one Gram matrix of (1, features, target), of coefficients."""
    v = np.concatenate([-np.asarray(coefficients), [1.0]])
    return float(np.sqrt(max(v @ validation @ v, 0.0) / validation[0, 0]))


class Objective:
    """scores(step, trials) of one model over (train, validation) pairs; close() frees what it keeps."""

    def __init__(self, pairs: Sequence[tuple[DataFrame, DataFrame]], task: str, model: str, seed: int, class_names: Sequence[str], base: Mapping[str, object]):
        self.pairs, self.task, self.model, self.seed = list(pairs), task, model, seed
        self.classes, self.base = len(class_names) or 2, dict(base)
        self._prepared: dict[tuple, tuple[DataFrame, DataFrame]] = {}
        self._kept: dict[tuple, list[int] | None] = {}
        self._grams: dict[tuple, dict[int, np.ndarray]] = {}
        self._neighbours: dict[tuple, DataFrame] = {}

    def preparation(self, params: Mapping[str, object]) -> tuple:
        """Imputer, scaler and encoder of a trial."""
        chosen = {**self.base, **params_part(params, "prep")}
        return tuple(str(chosen[k]) for k in ("numeric_imputer", "scaler", "cat_encoder"))

    def _rows(self, step: int, key: tuple) -> tuple[DataFrame, DataFrame]:
        if (step, key) not in self._prepared:
            train, validation = self.pairs[step]
            names = [c for c in train.columns if c not in ("row_id", TARGET, "fold")]
            numeric, categorical = split_columns(train.select(*names))
            prep = Preprocessor(numeric, categorical, self.task, *key, seed=self.seed, classes=self.classes).fit(train)
            columns = ("row_id", TARGET, "features")
            sides = prep.transform(train, training=True).select(*columns), prep.transform(validation).select(*columns)
            self._prepared[step, key] = tuple(side.persist() for side in sides)
        return self._prepared[step, key]

    def _positions(self, step: int, key: tuple, select: tuple) -> list[int] | None:
        if (step, key, select) not in self._kept:
            strategy, percentile, share = select
            train = self._rows(step, key)[0]
            self._kept[step, key, select] = select_features(train, strategy, self.task, self.classes, percentile, share, self.seed)
        return self._kept[step, key, select]

    def scores(self, step: int, trials: Sequence[Trial]) -> dict[int, float]:
        """The primary score of each trial on the step's validation rows."""
        groups: dict[tuple, dict[tuple, list[Trial]]] = {}
        for trial, params in trials:
            select = params_part(params, "select")
            chosen = str(select.get("strategy", "none")), int(float(select.get("percentile", 50))), float(select.get("n_features_fraction", 0.5))
            groups.setdefault(self.preparation(params), {}).setdefault(chosen, []).append((trial, params))
        # Preparations are independent chains of small jobs: several at a time keep the executors busy.
        with ThreadPoolExecutor(max_workers=max(1, min(PARALLEL_GROUPS, len(groups)))) as pool:
            parts = list(pool.map(lambda group: self._group_scores(step, *group), groups.items()))
        found = {trial: score for scored, _ in parts for trial, score in scored.items()}
        frames = [frame for _, unscored in parts for frame in unscored]
        if frames:
            preds = reduce(DataFrame.unionByName, frames)
            wide = metrics.roc_auc(preds, ["trial"]) if self.task == "classification" else metrics.regression_metrics(preds, ["trial"])
            found |= {r["trial"]: r[metrics.PRIMARY[self.task]] for r in wide.collect()}
        return found

    def _group_scores(self, step: int, key: tuple, selections: Mapping[tuple, Sequence[Trial]]) -> tuple[dict[int, float], list[DataFrame]]:
        """Of the trials of one preparation: the scores that are known, and predictions that are still to be scored."""
        found: dict[int, float] = {}
        frames: list[DataFrame] = []
        for select, members in selections.items():
            kept = self._positions(step, key, select)
            if self.task == "regression" and self.model in ("linear", "lasso"):
                found |= self._by_gram(step, key, kept, members)
                continue
            train, validation = (side if kept is None else keep_positions(side, kept) for side in self._rows(step, key))
            if self.model == "knn":
                frames += self._by_neighbours((step, key, select), train, validation, members)
            else:
                frames += self._by_fits(train, validation, members)
        return found, frames

    def _by_gram(self, step: int, key: tuple, kept: list[int] | None, members: Sequence[Trial]) -> dict[int, float]:
        if (step, key) not in self._grams:
            sides = [side.select(TARGET, "features", F.lit(i).alias("fold")) for i, side in enumerate(self._rows(step, key))]
            self._grams[step, key] = gram_by_fold(sides[0].unionByName(sides[1]))
        grams = self._grams[step, key]
        at = np.arange(len(grams[0])) if kept is None else np.array([0, *[k + 1 for k in kept], len(grams[0]) - 1])
        train, validation = (grams[i][np.ix_(at, at)] for i in range(2))
        solve = ridge_solution if self.model == "linear" else lasso_solution
        return {t: -gram_rmse(train, validation, solve(train, float(params.get("model.alpha", 1.0)))) for t, params in members}

    def _by_neighbours(self, key: tuple, train: DataFrame, validation: DataFrame, members: Sequence[Trial]) -> list[DataFrame]:
        specs = [(t, int(float(p.get("model.n_neighbors", 5))), str(p.get("model.weights", "uniform"))) for t, p in members]
        key = (*key, max([MAX_K, *[k for _, k, _ in specs]]))
        if key not in self._neighbours:
            self._neighbours[key] = neighbour_table(train, validation, key[-1]).persist()
        truth = validation.select(F.col("row_id").alias("query_id"), F.col(TARGET).alias("y"))
        votes = [(t, vote(self._neighbours[key], k, weights, self.task, self.classes)) for t, k, weights in specs]
        return [self._judged(v.join(truth, "query_id"), t) for t, v in votes]

    def _by_fits(self, train: DataFrame, validation: DataFrame, members: Sequence[Trial]) -> list[DataFrame]:
        rounds = ROUNDS.get(self.model)
        count = lambda params: int(float(params.get(rounds, DEFAULT_ROUNDS[self.model])))
        alike: dict[tuple, list[Trial]] = {}
        for trial, params in members:
            rest = tuple(sorted((k, str(v)) for k, v in params_part(params, "model").items() if f"model.{k}" != rounds))
            alike.setdefault(rest if rounds else (trial,), []).append((trial, params))
        out = []
        for same in alike.values():
            longest = max(same, key=lambda member: count(member[1])) if rounds else same[0]
            fitted = build_model(self.model, self.task, self.seed, params_part(longest[1], "model"), self.classes).fit(train)
            for trial, params in same:
                model = replace(fitted, trees=fitted.trees[: count(params)]) if len(same) > 1 else fitted
                out.append(self._judged(model.predict(validation).withColumn("y", F.col(TARGET)), trial))
        return out

    def _judged(self, preds: DataFrame, trial: int) -> DataFrame:
        return preds.select(F.lit(trial).alias("trial"), "y", *(["proba"] if self.task == "classification" else []), "pred")

    def close(self) -> None:
        for sides in self._prepared.values():
            for side in sides:
                side.unpersist()
        for table in self._neighbours.values():
            table.unpersist()
