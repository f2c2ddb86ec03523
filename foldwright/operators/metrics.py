"""Quality, calibration and interval metrics as grouped aggregates.

Input is one prediction table ``(keys..., row_id, y, pred, proba)``: labels are
0..K-1 integers and ``proba`` an array for classification, doubles otherwise.
All functions group by ``keys`` (e.g. run and fold), so one job scores
everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions.scalar import argmax, normal_ppf_sql
from foldwright.operators.ordering import prefix_sums

FLOAT_EPS = 2.220446049250313e-16
ECE_BINS = 15
PRIMARY = {"classification": "roc_auc", "regression": "neg_rmse"}


def _confusion(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    return preds.groupBy(*keys, "y", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """accuracy, balanced_accuracy and macro f1 from one confusion table."""
    cells = F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("guessed"),
                 F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("guessed"),
                 F.lit(0).cast("long").alias("hit")),
    )
    per_class = (
        _confusion(preds, keys)
        .select(*keys, F.inline(cells))
        .groupBy(*keys, "class")
        .agg(*[F.sum(c).alias(c) for c in ("actual", "guessed", "hit")])
    )
    recall = F.when(F.col("actual") > 0, F.col("hit") / F.col("actual"))
    f1 = F.col("hit") * 2.0 / (F.col("actual") + F.col("guessed"))
    return per_class.groupBy(*keys).agg(
        (F.sum("hit") / F.sum("actual")).alias("accuracy"),
        F.avg(recall).alias("balanced_accuracy"),
        F.avg(F.coalesce(f1, F.lit(0.0))).alias("f1_macro"),
    )


def roc_auc(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Binary AUC, or macro one-vs-rest AUC over the classes; ties count half.

    Rows collapse to distinct (class, score) first; negatives below a score come
    from bucketed prefix sums, so no class is gathered in one task.
    """
    binary = F.size("proba") == 2
    wanted = F.filter(
        F.transform(
            F.col("proba"),
            lambda p, i: F.struct(
                i.alias("class"), p.alias("score"), (F.col("y") == i).cast("long").alias("pos")
            ),
        ),
        lambda s: ~binary | (s["class"] == 1),
    )
    counts = (
        preds.select(*keys, F.inline(wanted))
        .groupBy(*keys, "class", "score")
        .agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))
    )
    ranked = prefix_sums(counts, [*keys, "class"], "score", ["pos", "neg"])
    won = F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)
    per_class = ranked.groupBy(*keys, "class").agg(
        F.try_divide(
            F.sum(won), F.max("total_pos").cast("double") * F.max("total_neg")
        ).alias("auc")
    )
    return per_class.groupBy(*keys).agg(F.avg("auc").alias("roc_auc"))


def _loss() -> Column:
    """-log of the probability of the label, clipped."""
    p = F.element_at("proba", F.col("y").cast("int") + 1)
    return -F.log(F.greatest(F.least(p, F.lit(1 - FLOAT_EPS)), F.lit(FLOAT_EPS)))


def log_loss(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg(_loss()).alias("log_loss"))


def regression_metrics(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rmse, neg_rmse, mae and r2; a constant target gives 0, or 1 when perfect."""
    error = F.col("y") - F.col("pred")
    sums = preds.groupBy(*keys).agg(
        F.avg(error * error).alias("_mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop("y").alias("_var"),
    )
    r2 = (
        F.when(F.col("_var") > 0, 1 - F.col("_mse") / F.col("_var"))
        .when(F.col("_mse") == 0, 1.0)
        .otherwise(0.0)
    )
    rmse = F.sqrt("_mse")
    return sums.select(*keys, rmse.alias("rmse"), (-rmse).alias("neg_rmse"), "mae", r2.alias("r2"))


def confidence_bin(confidence: Column, bins: int = ECE_BINS) -> Column:
    """Bin index 1..bins of ``(lo, hi]`` bins; NULL for a confidence of exactly 0.

    ``ceil`` can be off by one next to an edge, so it is set right against the
    edges i/bins themselves.
    """
    guess = F.ceil(confidence * bins).cast("int")
    edge = lambda i: i.cast("double") / F.lit(float(bins))
    lowered = F.when(confidence <= edge(guess - 1), guess - 1).otherwise(guess)
    right = F.when(confidence > edge(lowered), lowered + 1).otherwise(lowered)
    return F.when(confidence > 0, right)


def expected_calibration_error(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Top-label ECE over 15 bins."""
    confidence = F.array_max("proba")
    hit = (argmax(F.col("proba")) == F.col("y")).cast("long")
    bins = (
        preds.select(*keys, confidence.alias("_c"), hit.alias("_h"))
        .withColumn("_bin", confidence_bin(F.col("_c")))
        .groupBy(*keys, "_bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_h").alias("hits"), F.sum("_c").alias("conf"))
    )
    gap = F.when(F.col("_bin").isNotNull(), F.abs(F.col("hits") - F.col("conf"))).otherwise(0.0)
    return bins.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def _squared_distance() -> Column:
    squares = F.transform(
        "proba", lambda p, i: F.pow(p - (F.col("y") == i).cast("double"), F.lit(2.0))
    )
    return F.aggregate(squares, F.lit(0.0), lambda a, b: a + b)


def brier_score(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean squared distance to the one-hot label (0..2)."""
    return preds.groupBy(*keys).agg(F.avg(_squared_distance()).alias("brier"))


def interval_metrics(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coverage (inclusive) and mean width over the target's std (ddof 0; 0 counts as 1)."""
    covered = (F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))
    spread = F.stddev_pop("y")
    return preds.groupBy(*keys).agg(
        F.avg(covered.cast("double")).alias("picp_80"),
        (F.avg(F.col("upper") - F.col("lower")) / F.when(spread > 0, spread).otherwise(1.0)).alias(
            "mpiw_80_norm"
        ),
    )


def gaussian_interval(df: DataFrame, coverage: float = 0.8) -> DataFrame:
    """lower/upper = mean -/+ z * std."""
    z = F.expr(normal_ppf_sql(f"{0.5 + coverage / 2:.17e}"))
    return df.withColumn("lower", F.col("mean") - z * F.col("std")).withColumn(
        "upper", F.col("mean") + z * F.col("std")
    )


def sorted_bounds(df: DataFrame, a: str, b: str) -> DataFrame:
    """Interval bounds from two quantile predictions, in order."""
    return df.withColumn("lower", F.least(a, b)).withColumn("upper", F.greatest(a, b))


def _counted_metrics(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All classification metrics but the AUC from one pass over the predictions.

    The pass leaves one row per (label, prediction, confidence bin); each of them counts for
    its two classes, its bin and the totals.
    """
    cells = (
        preds.select(
            *keys, "y", "pred", F.array_max("proba").alias("_c"), _loss().alias("_loss"),
            _squared_distance().alias("_brier"), (argmax(F.col("proba")) == F.col("y")).cast("long").alias("_h"),
        )
        .withColumn("_bin", confidence_bin(F.col("_c")))
        .groupBy(*keys, "y", "pred", "_bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_h").alias("hits"),
             *[f(v).alias(f"{name}{v}") for v in ("_c", "_loss", "_brier") for f, name in ((F.sum, "sum"), (F.count, "rows"))])
    )
    same = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)

    def part(kind: str, of: Column, *sums: Column) -> Column:
        values = [v.cast("double").alias(name) for name, v in zip("abc", sums)]
        return F.struct(F.lit(kind).alias("_kind"), of.cast("double").alias("_of"), *values)

    zero, nothing = F.lit(0), F.lit(None)
    sums = (
        cells.select(*keys, F.inline(F.array(
            part("class", F.col("y"), F.col("n"), zero, same),
            part("class", F.col("pred"), zero, F.col("n"), zero),
            part("bin", F.col("_bin"), F.col("hits"), F.col("sum_c"), F.col("n")),
            part("loss", nothing, F.col("sum_loss"), zero, F.col("rows_loss")),
            part("brier", nothing, F.col("sum_brier"), zero, F.col("rows_brier")),
        )))
        .groupBy(*keys, "_kind", "_of")
        .agg(*[F.sum(v).alias(v) for v in "abc"])
    )
    of = lambda kind, value: F.when(F.col("_kind") == kind, value)
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    gap = F.when(F.col("_of").isNotNull(), F.abs(a - b)).otherwise(0.0)
    share = lambda kind, over, under: F.try_divide(F.sum(of(kind, over)), F.sum(of(kind, under)))
    return sums.groupBy(*keys).agg(
        share("class", c, a).alias("accuracy"),
        F.avg(of("class", F.when(a > 0, c / a))).alias("balanced_accuracy"),
        F.avg(of("class", F.coalesce(F.try_divide(c * 2.0, a + b), F.lit(0.0)))).alias("f1_macro"),
        share("loss", a, c).alias("log_loss"),
        share("bin", gap, c).alias("ece"),
        share("brier", a, c).alias("brier"),
    )


def classification_panel(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All classification metrics, one row per key."""
    counted = _counted_metrics(preds, keys)
    wide = counted.join(roc_auc(preds, keys), list(keys))  # One row per key on each side.
    return wide.select(*keys, "accuracy", "balanced_accuracy", "f1_macro", "roc_auc", "log_loss", "ece", "brier")


def panel(preds: DataFrame, keys: Sequence[str], task: str) -> DataFrame:
    """Long metric rows (keys..., name, value) of one task."""
    wide = classification_panel(preds, keys) if task == "classification" else regression_metrics(preds, keys)
    if task == "regression" and "lower" in preds.columns:
        wide = wide.join(interval_metrics(preds, keys), list(keys))
    return wide.unpivot(
        list(keys), [c for c in wide.columns if c not in keys], "name", "value"
    )


def primary_score(metrics: DataFrame, keys: Sequence[str], task: str) -> DataFrame:
    """Primary metric (higher is better) per key from long metric rows."""
    return metrics.filter(F.col("name") == PRIMARY[task]).select(
        *keys, F.col("value").alias("primary")
    )


def fold_aggregate(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and std (ddof 0) over folds of each metric, as ``<name>_mean/_std`` rows."""
    stats = metrics.groupBy(*keys, "name").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    rows = F.array(
        F.struct(F.concat("name", F.lit("_mean")).alias("metric"), F.col("mean").alias("value")),
        F.struct(F.concat("name", F.lit("_std")).alias("metric"), F.col("std").alias("value")),
    )
    return stats.select(*keys, F.inline(rows))


def running_mean(steps: DataFrame, trial_keys: Sequence[str]) -> DataFrame:
    """Value reported after each inner fold: the mean so far. Steps per trial are few."""
    from pyspark.sql import Window

    so_far = Window.partitionBy(*trial_keys).orderBy("step").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return steps.withColumn("reported", F.avg("value").over(so_far))
