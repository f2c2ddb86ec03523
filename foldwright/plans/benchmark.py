"""Sweeps: plan on Spark, run what is missing, keep going on failures."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.plans.experiment import run_experiment
from foldwright.sources import config
from foldwright.sources.datasets import Dataset
from foldwright.sources.runstore import RunStore

DETAIL_LIMIT = 300


def plan(sweep: DataFrame, registry: DataFrame, finished: DataFrame) -> DataFrame:
    """Sweep grid with gating reason, data variant and whether each run is already finished.

    A dataset with ``local_subset_rows`` runs on that subset unless the sweep asks for full data.
    """
    spark = sweep.sparkSession
    has_subset = F.col("local_subset_rows").isNotNull() if "local_subset_rows" in registry.columns else F.lit(False)
    subsets = registry.select(F.col("name").alias("dataset"), has_subset.alias("has_subset"))
    gated = config.gate(config.sweep_grid(sweep), registry, config.model_limits(spark)).join(subsets, "dataset")
    gated = gated.withColumn(
        "data_variant", F.when(F.col("has_subset") & ~F.col("full_data"), "local_subset").otherwise("full")
    ).drop("has_subset")
    keys = list(config.RESUME_KEYS)
    done = config.already_done(gated, finished).select(*keys).distinct().withColumn("existing", F.lit(True))
    return gated.join(done, keys, "left").withColumn(
        "status",
        F.when(F.col("reason").isNotNull(), "skipped_gated")
        .when(F.col("existing"), "skipped_existing")
        .otherwise("planned"),
    ).drop("existing")


def run_benchmark(
    sweep: DataFrame,
    registry: DataFrame,
    load: Callable[..., Dataset],
    store: RunStore,
    expert: DataFrame | None = None,
    budget: Mapping[str, int] | None = None,
    measure_cost: bool = True,
) -> DataFrame:
    """Outcome rows of a sweep. A failing run becomes a ``failed`` row and the sweep goes on.

    The plan has one row per run; the driver walks it, since every run is itself
    a sequence of Spark jobs. ``load`` gets the dataset's name and, if it takes a
    second argument, whether the sweep asks for full data.
    """
    spark = sweep.sparkSession
    expert = config.expert_params(spark) if expert is None else expert
    planned = plan(sweep, registry, store.finished_keys()).persist()
    takes_variant = len(inspect.signature(load).parameters) > 1
    params: dict[tuple[str, str], dict[str, str]] = {}
    for r in config.resolve_expert(expert, planned).collect():
        params.setdefault((r["dataset"], r["model"]), {})[r["param"]] = r["value"]
    outcomes = []
    for r in planned.orderBy("dataset", "model", "seed", "mode").collect():
        status, detail = r["status"], r["reason"] or ""
        if status == "planned":
            mode = "automated" if r["mode"] == "automated" else "baseline"
            fixed = params.get((r["dataset"], r["model"]), {}) if r["mode"] == "baseline_expert" else {}
            try:
                run_experiment(
                    load(r["dataset"], *([r["full_data"]] if takes_variant else [])), r["model"], r["seed"], r["budget_profile"], mode, fixed, store,
                    budget, {"benchmark_mode": r["mode"], "benchmark": r["name"]}, measure_cost,
                )
                status = "completed"
            except Exception as error:  # noqa: BLE001 - one bad run must not end the sweep
                status, detail = "failed", f"{type(error).__name__}: {error}"[:DETAIL_LIMIT]
        outcomes.append((r["dataset"], r["model"], r["seed"], r["mode"], status, detail))
    planned.unpersist()
    if outcomes:
        store.append("outcomes", outcomes)
    return spark.createDataFrame(
        outcomes, "dataset string, model string, seed int, mode string, status string, detail string"
    )


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Counts by status, and which of them mean failure."""
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "failure", F.col("status") == "failed"
    )
