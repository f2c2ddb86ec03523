"""Trial tables: sampling, proposal, pruning and choice of the best trial."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions.scalar import hash_unit

STARTUP_TRIALS = 4
WARMUP_STEPS = 1
HALVING_FACTOR = 4
GOOD_SHARE = 0.25
CANDIDATES = 24


def drawn_value(u: Column) -> Column:
    """Value of a parameter row for a uniform draw, as text."""
    low, high = F.col("low"), F.col("high")
    steps = F.floor((high - low) / F.col("step")) + 1
    whole = low + F.col("step") * F.floor(u * steps)
    return (
        F.when(
            F.col("kind") == "categorical",
            F.get("choices", F.floor(u * F.size("choices")).cast("int")),
        )
        .when(F.col("kind") == "int", whole.cast("long").cast("string"))
        .when(F.col("kind") == "fixed", low.cast("long").cast("string"))
        .when(F.col("kind") == "log", F.round(F.exp(F.log("low") + u * (F.log("high") - F.log("low"))), 9).cast("string"))
        .otherwise(F.round(low + u * (high - low), 9).cast("string"))
    )


def sample_values(space: DataFrame, n: int, seed: int, first: int = 0) -> DataFrame:
    """Long trial table (space keys..., trial, param, value), conditional parameters kept only where they apply.

    Each value comes from md5(seed:trial:param), so trials do not depend on order.
    """
    drawn = space.withColumn(
        "trial", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1)))
    ).withColumn("u", hash_unit(F.lit(seed), F.col("trial"), F.col("param")))
    valued = drawn.withColumn("value", drawn_value(F.col("u")))
    keys = [c for c in space.columns if c in ("dataset", "model", "task", "tier", "has_categorical")]
    # A trial has about 15 parameters: a condition looks at its sibling in the same trial.
    siblings = Window.partitionBy(*keys, "trial")
    chosen = F.map_from_entries(F.collect_list(F.struct("param", "value")).over(siblings))
    applies = F.col("depends_on").isNull() | (
        F.try_element_at("_all", F.col("depends_on")) == F.col("depends_value")
    )
    return valued.withColumn("_all", chosen).filter(applies).select(*keys, "trial", "param", "value")


def sample_trials(space: DataFrame, n: int, seed: int, first: int = 0) -> DataFrame:
    """One row per trial with the full parameter map."""
    values = sample_values(space, n, seed, first)
    keys = [c for c in values.columns if c not in ("param", "value")]
    return values.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("param", "value")))).alias("params")
    )


def propose(
    space: DataFrame, history: DataFrame, n: int, seed: int, first: int, candidates: int = CANDIDATES
) -> DataFrame:
    """Next trials from the history (trial, params, value): density ratio of good to other trials.

    A batch proposal, not a trial-for-trial copy of a sequential sampler: random
    candidates are ranked by the product over parameters of kernel densities in
    the best quarter against the rest. Histories hold at most a few hundred trials.
    """
    pool = sample_values(space, candidates * n, seed, first=first)
    done = history.filter(F.col("value").isNotNull())
    # A history is bounded by the trial budget, so one small window ranks it.
    ranked = done.withColumn(
        "_share", F.percent_rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("value"), "trial"))
    )
    past = ranked.select(
        F.explode("params").alias("param", "seen"), (F.col("_share") <= GOOD_SHARE).alias("good")
    )
    kinds = space.select("param", "kind", "low", "high", F.size("choices").alias("n_choices"))
    number = lambda c: F.when(
        F.col("kind") == "log", F.log(F.col(c).cast("double"))
    ).otherwise(F.col(c).cast("double"))
    width = F.when(F.col("kind") == "log", F.log("high") - F.log("low")).otherwise(
        F.col("high") - F.col("low")
    )
    gap = (number("value") - number("seen")) / F.nullif(width * 0.2, F.lit(0.0))
    near = F.when(
        F.col("kind") == "categorical",
        F.when(F.col("value") == F.col("seen"), 1.0).otherwise(0.0),
    ).otherwise(F.coalesce(F.exp(-gap * gap / 2), F.lit(1.0)))
    scored = (
        pool.join(F.broadcast(kinds), "param")
        .join(F.broadcast(past), "param", "left")
        .groupBy("trial", "param")
        .agg(
            F.avg(F.when(F.col("good"), near)).alias("l"),
            F.avg(F.when(~F.col("good"), near)).alias("g"),
        )
        .groupBy("trial")
        .agg(
            F.sum(
                F.log(F.coalesce("l", F.lit(1.0)) + 0.05) - F.log(F.coalesce("g", F.lit(1.0)) + 0.05)
            ).alias("score")
        )
    )
    # Trials are numbered by candidate block; the best of each block is proposed.
    block = F.floor((F.col("trial") - first) / candidates)
    best = scored.withColumn("_block", block).groupBy("_block").agg(
        F.max_by("trial", F.struct("score", (-F.col("trial")).alias("t"))).alias("trial")
    )
    chosen = pool.join(F.broadcast(best), "trial")
    keys = [c for c in pool.columns if c not in ("trial", "param", "value")]
    return chosen.groupBy(*keys, "_block").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("param", "value")))).alias("params")
    ).select(*keys, (F.lit(first) + F.col("_block")).cast("int").alias("trial"), "params")


def median_prune(
    steps: DataFrame,
    study: Sequence[str],
    startup: int = STARTUP_TRIALS,
    warmup: int = WARMUP_STEPS,
) -> DataFrame:
    """Mark steps where a trial stops: its best value so far is below the median of earlier trials.

    Input (study..., trial, step, reported). Earlier trials count at the same
    step; nothing is pruned before ``startup`` trials or in the warm-up steps.
    A study has at most a few hundred trials, so its windows are small.
    """
    study = list(study)
    so_far = Window.partitionBy(*study, "trial").orderBy("step").rowsBetween(
        Window.unboundedPreceding, 0
    )
    earlier = Window.partitionBy(*study, "step").orderBy("trial").rowsBetween(
        Window.unboundedPreceding, -1
    )
    marked = (
        steps.withColumn("best", F.max("reported").over(so_far))
        .withColumn("median", F.percentile("reported", 0.5).over(earlier))
        .withColumn("n_earlier", F.count(F.lit(1)).over(earlier))
    )
    stop = (
        (F.col("n_earlier") >= startup)
        & (F.col("step") >= warmup)
        & (F.col("best") < F.col("median"))
    )
    return marked.withColumn("pruned", stop)


def successive_halving(rungs: DataFrame, study: Sequence[str], factor: int = HALVING_FACTOR) -> DataFrame:
    """Keep the top 1/factor of each rung (at least one). Rungs hold a study's trials only."""
    per_rung = Window.partitionBy(*study, "rung")
    place = F.row_number().over(per_rung.orderBy(F.desc("value"), "trial"))
    keep = F.greatest(F.floor(F.count(F.lit(1)).over(per_rung) / factor), F.lit(1))
    return rungs.withColumn("place", place).withColumn("survives", F.col("place") <= keep)


def best_trial(trials: DataFrame, study: Sequence[str]) -> DataFrame:
    """Full parameters of the best trial, the earliest on ties."""
    order = F.struct("value", (-F.col("trial")).alias("t"))
    done = trials.filter(F.col("value").isNotNull())
    return done.groupBy(*study).agg(
        F.max_by(F.struct("trial", "params", "value"), order).alias("b")
    ).select(*study, "b.trial", "b.params", "b.value")
