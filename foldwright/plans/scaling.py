"""Scaling study: the same test rows, growing nested training subsets."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.models.zoo import is_allowed
from foldwright.operators import splits
from foldwright.plans.experiment import _score, prepare_rows
from foldwright.plans.pipeline import fit_pipeline
from foldwright.sources.datasets import Dataset
from foldwright.sources.registry import tier_of
from foldwright.sources.runstore import RunStore

SCHEMA = (
    "dataset string, model string, fraction double, n_rows long, primary double, fit_seconds double, model_size_mb double"
)


def subset_sizes(train: DataFrame, fractions: Sequence[float], seed: int) -> DataFrame:
    """(fraction, n_rows) of the nested subsets."""
    return splits.nested_fractions(train.select("row_id"), fractions, seed).groupBy("fraction").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def scaling_study(
    ds: Dataset,
    models: Sequence[str],
    fractions: Sequence[float] = splits.SCALING_FRACTIONS,
    seed: int = 42,
    expert: Mapping[str, Mapping[str, object]] | None = None,
    store: RunStore | None = None,
) -> DataFrame:
    """One row per (model, fraction) on outer fold 0; gated models are left out."""
    rows, class_names, n = prepare_rows(ds)
    spark = rows.sparkSession
    tier = tier_of(ds.expected_rows or n)
    folded = splits.outer_folds(rows, seed, ds.task, n).persist()
    train, test = splits.fold_sides(folded, 0)
    nested = splits.nested_fractions(train.drop("fold"), fractions, seed).persist()
    out = []
    for model in models:
        if not is_allowed(model, tier):
            continue
        for fraction in sorted(fractions):
            part = nested.filter(F.col("fraction") == float(fraction)).drop("fraction", "rn")
            size = part.count()
            start = time.perf_counter()
            pipeline = fit_pipeline(
                part, ds.task, model, (expert or {}).get(model, {}), seed, class_names)
            seconds = time.perf_counter() - start
            score = _score(pipeline, test)
            out.append((ds.name, model, float(fraction), size, score, seconds, pipeline.size_mb(spark)))
            if store is not None:
                store.log_run(
                    ds.name, f"scaling__{ds.name}__{model}__{fraction}",
                    {"dataset": ds.name, "model": model, "scaling": "true", "scaling_fraction": fraction},
                    {"seed": seed},
                    [("n_train_rows", size, None), ("primary", score, None), ("fit_seconds", seconds, None)])
    nested.unpersist()
    folded.unpersist()
    return spark.createDataFrame(out, SCHEMA).orderBy("dataset", "model", "fraction")
