"""Study configuration as tables: budgets, expert parameters, sweeps, search spaces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.models.zoo import MAX_TIER, REGRESSION_ONLY
from foldwright.sources.registry import tier_rank

MODES = ("automated", "baseline_default", "baseline_expert")
MODE_LABELS = {
    "automated": "Automated",
    "baseline_default": "Defaults",
    "baseline_expert": "Expert",
}

# Search budgets as (profile, tier, trials, seconds, inner folds).
BUDGETS = (
    ("smoke", "small", 8, 300, 3),
    ("smoke", "medium", 6, 600, 3),
    ("smoke", "large", 4, 900, 1),
    ("local", "small", 50, 1800, 3),
    ("local", "medium", 30, 3600, 3),
    ("local", "large", 15, 7200, 1),
    ("full", "small", 150, 7200, 3),
    ("full", "medium", 100, 14400, 3),
    ("full", "large", 40, 28800, 1),
)
MAX_TRIALS = max(b[2] for b in BUDGETS)

# Expert parameters as (scope, key, model, param, value).
_BOTH = (
    ("sgd_linear", "model.alpha", "0.0001"),
    ("random_forest", "model.n_estimators", "500"),
    ("extra_trees", "model.n_estimators", "500"),
    ("hist_gb", "model.learning_rate", "0.06"),
    ("hist_gb", "model.max_iter", "300"),
    ("svm", "model.C", "1.0"),
    ("svm", "model.gamma", "0.1"),
    ("knn", "model.n_neighbors", "11"),
    ("knn", "model.weights", "distance"),
    ("xgboost", "model.n_estimators", "500"),
    ("xgboost", "model.learning_rate", "0.05"),
    ("xgboost", "model.max_depth", "6"),
    ("xgboost", "model.subsample", "0.8"),
    ("xgboost", "model.colsample_bytree", "0.8"),
    ("torch_mlp", "model.hidden_dim", "128"),
    ("torch_mlp", "model.n_layers", "2"),
    ("torch_mlp", "model.dropout", "0.1"),
    ("torch_mlp", "model.lr", "0.001"),
)
EXPERT_PARAMS = (
    ("task", "classification", "linear", "model.C", "1.0"),
    ("task", "classification", "random_forest", "model.min_samples_leaf", "1"),
    ("task", "regression", "linear", "model.alpha", "1.0"),
    ("task", "regression", "lasso", "model.alpha", "0.01"),
    ("task", "regression", "random_forest", "model.min_samples_leaf", "2"),
    *(("task", task, m, p, v) for task in ("classification", "regression") for m, p, v in _BOTH),
    ("dataset", "higgs", "xgboost", "model.n_estimators", "500"),
    ("dataset", "higgs", "xgboost", "model.learning_rate", "0.1"),
    ("dataset", "higgs", "xgboost", "model.max_depth", "8"),
    ("dataset", "higgs", "torch_mlp", "model.hidden_dim", "256"),
    ("dataset", "higgs", "torch_mlp", "model.n_layers", "3"),
)

# Sweeps as (name, profile, full data, seeds, datasets, models).
_ALL_MODELS = ("linear", "sgd_linear", "random_forest", "extra_trees", "hist_gb", "svm", "knn",
               "xgboost", "torch_mlp")
_LOCAL_DATASETS = ("breast_cancer", "wine", "ionosphere", "diabetes", "concrete_strength",
                   "energy_efficiency", "phoneme", "spambase", "adult", "california_housing",
                   "superconductivity", "covertype", "year_prediction_msd")
SWEEPS = (
    ("smoke", "smoke", False, (42, 43),
     ("wine", "breast_cancer", "ionosphere", "diabetes", "concrete_strength", "phoneme"),
     ("linear", "hist_gb", "xgboost")),
    ("local", "local", False, (42, 43, 44), _LOCAL_DATASETS, _ALL_MODELS),
    ("full", "full", True, (42, 43, 44, 45, 46), (*_LOCAL_DATASETS, "higgs", "susy"), _ALL_MODELS),
)


def budgets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(BUDGETS), "profile string, tier string, n_trials int, timeout_s int, inner_folds int"
    )


def get_budget(profile: str, tier: str) -> dict[str, int]:
    for p, t, trials, seconds, folds in BUDGETS:
        if (p, t) == (profile, tier):
            return {"n_trials": trials, "timeout_s": seconds, "inner_folds": folds}
    known = ", ".join(sorted({b[0] for b in BUDGETS}))
    raise KeyError(f"no budget profile {profile!r}; profiles: {known}")


def expert_params(spark: SparkSession, rows: Sequence[tuple] = EXPERT_PARAMS) -> DataFrame:
    return spark.createDataFrame(
        list(rows), "scope string, key string, model string, param string, value string"
    )


def resolve_expert(expert: DataFrame, planned: DataFrame) -> DataFrame:
    """Parameters per planned (dataset, task, model): task defaults, dataset overrides.

    The expert table is a configuration of a few dozen rows.
    """
    default = expert.filter("scope = 'task'").select(
        F.col("key").alias("task"), "model", "param", F.col("value").alias("default_value"))
    override = expert.filter("scope = 'dataset'").select(
        F.col("key").alias("dataset"), "model", "param", F.col("value").alias("override_value"))
    base = planned.select("dataset", "task", "model").distinct()
    a = base.join(F.broadcast(default), ["task", "model"]).drop("task")
    b = base.select("dataset", "model").join(F.broadcast(override), ["dataset", "model"])
    return a.join(b, ["dataset", "model", "param"], "full_outer").select(
        "dataset", "model", "param", F.coalesce("override_value", "default_value").alias("value"))


def sweep_config(
    spark: SparkSession,
    name: str,
    seeds: Sequence[int],
    datasets: Sequence[str],
    models: Sequence[str],
    modes: Sequence[str] = MODES,
    budget_profile: str = "smoke",
    full_data: bool = False,
) -> DataFrame:
    """One configuration row; modes, profile and full_data have defaults."""
    return spark.createDataFrame(
        [(name, list(seeds), list(datasets), list(models), list(modes), budget_profile, full_data)],
        "name string, seeds array<int>, datasets array<string>, models array<string>, "
        "modes array<string>, budget_profile string, full_data boolean",
    )


def known_sweep(spark: SparkSession, name: str) -> DataFrame:
    for n, profile, full, seeds, datasets, models in SWEEPS:
        if n == name:
            return sweep_config(spark, n, seeds, datasets, models, MODES, profile, full)
    raise KeyError(f"no sweep {name!r}; sweeps: {', '.join(s[0] for s in SWEEPS)}")


def model_limits(spark: SparkSession) -> DataFrame:
    rows = [(m, t, m in REGRESSION_ONLY) for m, t in MAX_TIER.items()]
    return spark.createDataFrame(rows, "model string, max_tier string, regression_only boolean")


def sweep_grid(config: DataFrame) -> DataFrame:
    """datasets x models x seeds x modes of each configuration row."""
    return (
        config.withColumn("dataset", F.explode("datasets"))
        .withColumn("model", F.explode("models"))
        .withColumn("seed", F.explode("seeds"))
        .withColumn("mode", F.explode("modes"))
        .select("name", "dataset", "model", "seed", "mode", "budget_profile", "full_data")
    )


def gate(grid: DataFrame, registry: DataFrame, limits: DataFrame) -> DataFrame:
    """Add task, tier and ``reason``: NULL when the model may run on the dataset.

    Registry and limits are configuration tables (datasets and model names).
    """
    joined = grid.join(
        F.broadcast(registry.select(F.col("name").alias("dataset"), "task", "tier")), "dataset"
    ).join(F.broadcast(limits), "model")
    too_big = tier_rank(F.col("tier")) > tier_rank(F.col("max_tier"))
    mismatch = F.col("regression_only") & (F.col("task") == "classification")
    return joined.withColumn(
        "reason", F.when(too_big, "tier-gated").when(mismatch, "task-mismatch")
    ).drop("max_tier", "regression_only")


RESUME_KEYS = ("dataset", "model", "seed", "mode", "budget_profile", "data_variant")


def remaining(planned: DataFrame, finished: DataFrame) -> DataFrame:
    """Planned runs without a finished run of the same keys (data variant included)."""
    return planned.join(finished.select(*RESUME_KEYS), list(RESUME_KEYS), "left_anti")


def already_done(planned: DataFrame, finished: DataFrame) -> DataFrame:
    return planned.join(finished.select(*RESUME_KEYS), list(RESUME_KEYS), "left_semi")


def mode_label(mode: Column) -> Column:
    """Display label of a mode, the mode itself when it has none."""
    labels = F.create_map(*[F.lit(x) for pair in MODE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, mode), mode)


# The searched ranges.
# param, kind, low, high, step, choices, condition (param = value), needs
_FORESTS = (
    ("model.n_estimators", "int", 100, 500, 100, None),
    ("model.max_depth", "int", 4, 24, 1, None),
    ("model.min_samples_leaf", "int", 1, 10, 1, None),
    ("model.max_features", "float", 0.3, 1.0, None, None),
)
MODEL_SPACE: Mapping[str, Sequence[tuple]] = {
    "linear": (("model.C", "log", 1e-3, 100.0, None, None, "classification"),
               ("model.alpha", "log", 1e-3, 100.0, None, None, "regression")),
    "lasso": (("model.alpha", "log", 1e-4, 10.0, None, None),),
    "sgd_linear": (("model.alpha", "log", 1e-6, 1e-2, None, None),
                   ("model.penalty", "categorical", None, None, None, ("l2", "l1", "elasticnet"))),
    "random_forest": _FORESTS,
    "extra_trees": _FORESTS,
    "hist_gb": (("model.learning_rate", "log", 0.01, 0.3, None, None),
                ("model.max_iter", "int", 100, 500, 50, None),
                ("model.max_leaf_nodes", "int", 15, 127, 1, None),
                ("model.l2_regularization", "log", 1e-6, 1.0, None, None)),
    "xgboost": (("model.n_estimators", "int", 100, 600, 50, None),
                ("model.learning_rate", "log", 0.01, 0.3, None, None),
                ("model.max_depth", "int", 3, 10, 1, None),
                ("model.subsample", "float", 0.6, 1.0, None, None),
                ("model.colsample_bytree", "float", 0.6, 1.0, None, None),
                ("model.min_child_weight", "log", 0.1, 10.0, None, None),
                ("model.reg_lambda", "log", 1e-3, 10.0, None, None)),
    "svm": (("model.C", "log", 0.01, 100.0, None, None),
            ("model.gamma", "log", 1e-4, 1.0, None, None)),
    "knn": (("model.n_neighbors", "int", 3, 50, 1, None),
            ("model.weights", "categorical", None, None, None, ("uniform", "distance"))),
    "torch_mlp": (("model.hidden_dim", "categorical", None, None, None, ("64", "128", "256")),
                  ("model.n_layers", "int", 1, 4, 1, None),
                  ("model.dropout", "float", 0.0, 0.4, None, None),
                  ("model.lr", "log", 1e-4, 1e-2, None, None),
                  ("model.weight_decay", "log", 1e-6, 1e-3, None, None)),
}
MLP_EPOCHS = {"small": 100, "medium": 50, "large": 20}
SPACE_SCHEMA = (
    "model string, param string, kind string, low double, high double, step double, "
    "choices array<string>, depends_on string, depends_value string, task string, tier string, "
    "needs_categorical boolean"
)


def space_rows() -> list[tuple]:
    """All searched parameters; model NULL means every model."""

    def row(model, p, kind, low, high, step, choices, dep=None, val=None, task=None, tier=None, cat=False):
        as_float = lambda v: None if v is None else float(v)
        return (model, p, kind, as_float(low), as_float(high), as_float(step),
                list(choices) if choices else None, dep, val, task, tier, cat)

    base = ("none", "filter", "l1", "tree")
    rows = [
        row(None, "prep.numeric_imputer", "categorical", None, None, None, ("median", "mean")),
        row(None, "prep.scaler", "categorical", None, None, None, ("standard", "robust", "quantile", "none")),
        row(None, "prep.cat_encoder", "categorical", None, None, None, ("onehot", "ordinal", "target"), cat=True),
        row(None, "select.strategy", "categorical", None, None, None, (*base, "rfe"), tier="small"),
        row(None, "select.strategy", "categorical", None, None, None, base, tier="medium"),
        row(None, "select.strategy", "categorical", None, None, None, base, tier="large"),
        row(None, "select.percentile", "int", 25, 100, 25, None, "select.strategy", "filter"),
        row(None, "select.n_features_fraction", "float", 0.3, 0.9, None, None, "select.strategy", "rfe", tier="small"),
    ]
    for model, params in MODEL_SPACE.items():
        for p in params:
            rows.append(row(model, *p[:6], task=p[6] if len(p) > 6 else None))
    for tier, epochs in MLP_EPOCHS.items():
        rows.append(row("torch_mlp", "model.max_epochs", "fixed", epochs, epochs, None, None, tier=tier))
        rows.append(row("torch_mlp", "model.batch_size", "fixed", 1024 if tier == "large" else 256,
                        1024 if tier == "large" else 256, None, None, tier=tier))
    return rows


def space_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(space_rows(), SPACE_SCHEMA)


def search_space(spark: SparkSession, targets: DataFrame) -> DataFrame:
    """Parameters of each target row (dataset, model, task, tier, has_categorical).

    The space table is a fixed configuration of about 60 rows.
    """
    space = space_table(spark).withColumnsRenamed(
        {"model": "_m", "task": "_task", "tier": "_tier"})
    fits = (
        (F.col("_m").isNull() | (F.col("_m") == F.col("model")))
        & (F.col("_task").isNull() | (F.col("_task") == F.col("task")))
        & (F.col("_tier").isNull() | (F.col("_tier") == F.col("tier")))
        & (~F.col("needs_categorical") | F.col("has_categorical"))
    )
    return targets.join(F.broadcast(space), fits).drop("_m", "_task", "_tier", "needs_categorical")
