"""Deterministic folds, holdouts and subsets by seeded hash order.

Every split is ``rank in seeded order`` plus arithmetic, so it depends on the
row keys and the seed only, never on partitioning. Ranks come from
:mod:`foldwright.operators.ordering`, which spreads each class over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.operators.columns import TARGET
from foldwright.operators.ordering import rank_cuts, seeded_place, seeded_rank
from foldwright.session import cut_lineage
from foldwright.sources.registry import MEDIUM_BELOW

OUTER_FOLDS = 5
HOLDOUT_FRACTION = 0.2
SUBSET_SEED = 20260707  # fixed, independent of the experiment seed
INNER_SEED_OFFSET = 1000
LARGE_TIER_FRACTIONS = (0.25, 1.0)
SCALING_FRACTIONS = (0.01, 0.05, 0.1, 0.33, 1.0)
MIN_SUBSET_ROWS = 50


def _strata(task: str, target: str) -> list[str]:
    return [target] if task == "classification" else []


def kfold(
    df: DataFrame,
    seed: int,
    task: str,
    k: int = OUTER_FOLDS,
    target: str = TARGET,
    within: Sequence[str] = (),
    expected_rows: int | None = None,
) -> DataFrame:
    """Add ``fold`` in 0..k-1: shuffled, stratified for classification.

    Fold sizes differ by at most one row overall: the classes are dealt one
    after the other. ``within`` deals separately inside other columns.
    """
    group = [*within, *_strata(task, target)]
    ranked = seeded_rank(df, seed, group, expected_rows=expected_rows)
    dealt = F.col("rn") - 1 + (F.col("group_offset") if not within else F.lit(0))
    return ranked.withColumn("fold", (dealt % k).cast("int")).drop(
        "rn", "group_n", "group_offset"
    )


def holdout(
    df: DataFrame,
    seed: int,
    task: str,
    fraction: float = HOLDOUT_FRACTION,
    target: str = TARGET,
    expected_rows: int | None = None,
) -> DataFrame:
    """Add ``fold``: 0 for the held-out share of each class, -1 for training rows."""
    ranked = seeded_rank(df, seed, _strata(task, target), expected_rows=expected_rows)
    quota = F.floor(F.col("group_n") * F.lit(fraction) + 0.5)
    return ranked.withColumn(
        "fold", F.when(F.col("rn") <= quota, 0).otherwise(-1).cast("int")
    ).drop("rn", "group_n", "group_offset")


def outer_folds(
    df: DataFrame, seed: int, task: str, n_rows: int, target: str = TARGET
) -> DataFrame:
    """Five folds below 100k rows, one 80/20 holdout from there on."""
    if n_rows >= MEDIUM_BELOW:
        return holdout(df, seed, task, target=target, expected_rows=n_rows)
    return kfold(df, seed, task, target=target, expected_rows=n_rows)


def n_outer_folds(n_rows: int) -> int:
    return 1 if n_rows >= MEDIUM_BELOW else OUTER_FOLDS


def inner_folds(
    folded: DataFrame, k: int, seed: int, task: str, outer: int = OUTER_FOLDS, target: str = TARGET
) -> DataFrame:
    """Inner folds of every outer training set in one job.

    Input has ``fold``; the result has one row per (row, outer_fold it trains)
    with ``inner_fold``. Only keys and target are carried.
    """
    trains = folded.select(
        "row_id",
        target,
        F.explode(
            F.filter(F.sequence(F.lit(0), F.lit(outer - 1)), lambda i: i != F.col("fold"))
        ).alias("outer_fold"),
    )
    dealt = kfold(
        trains, seed + INNER_SEED_OFFSET, task, k, target=target, within=["outer_fold"]
    )
    return dealt.withColumnRenamed("fold", "inner_fold")


def inner_holdout(train: DataFrame, seed: int, task: str, target: str = TARGET) -> DataFrame:
    """Validation split inside one outer training set (large tier)."""
    return holdout(train, seed + INNER_SEED_OFFSET, task, target=target)


def stratified_subset(
    df: DataFrame, n: int, task: str, target: str = TARGET, seed: int = SUBSET_SEED
) -> DataFrame:
    """``n`` rows, proportional per class, at least one per class, exactly ``n`` in all."""
    group = _strata(task, target)

    def quotas(sizes: DataFrame) -> DataFrame:
        if not group:
            return sizes.withColumn("rank", F.lit(n))
        allotted = class_quotas(sizes.withColumnRenamed("group_n", "class_n"), n, target)
        return allotted.select(target, F.col("class_n").alias("group_n"), F.col("quota").alias("rank"))

    cuts = rank_cuts(df, seed, quotas, group).drop("rank")
    if not group:
        return df.where(seeded_place(seed) <= _place(cuts.first())) if n > 0 else df.limit(0)
    # One row per class: the class count is bounded by the label set.
    placed = df.withColumn("_place", seeded_place(seed)).join(F.broadcast(cut_lineage(cuts)), group)
    return placed.where("_place <= cut").select(*df.columns)


def _place(row) -> Column:
    """A cut that was read, as a literal; null, which no row lies before, if there were no rows."""
    return F.struct(F.lit(row["cut"]["hash"]).alias("hash"), F.lit(row["cut"]["key"]).alias("key")) if row else F.lit(None)


def class_quotas(counts: DataFrame, n: int, target: str = TARGET) -> DataFrame:
    """Largest-remainder allocation of ``n`` rows over (class, class_n)."""
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("class_n").over(everything)
    share = counts.withColumn("_exact", F.col("class_n") * F.lit(n)).withColumn("_total", total)
    based = share.withColumn(
        "_base", F.greatest(F.floor(F.col("_exact") / F.col("_total")), F.lit(1))
    ).withColumn("_rest", F.col("_exact") % F.col("_total"))
    left = F.lit(n) - F.sum("_base").over(everything)
    order = everything.orderBy(F.desc("_rest"), target)
    return based.withColumn("_left", left).select(
        target,
        "class_n",
        (F.col("_base") + (F.row_number().over(order) <= F.col("_left")).cast("long")).alias("quota"),
    )


def nested_fractions(
    df: DataFrame,
    fractions: Sequence[float],
    seed: int,
    minimum: int = MIN_SUBSET_ROWS,
    expected_rows: int | None = None,
) -> DataFrame:
    """Nested subsets: one row per (fraction, member row).

    One seeded order serves all fractions, so a smaller subset is contained in
    every larger one. Sizes are max(floor(n * fraction), minimum).
    """
    parts = F.array(*[F.lit(float(f)) for f in fractions])

    def sizes(total: DataFrame) -> DataFrame:
        each = total.withColumn("fraction", F.explode(parts))
        return each.withColumn("rank", F.greatest(F.floor(F.col("group_n") * F.col("fraction")), F.lit(minimum)))

    # One cut per fraction is read.
    cuts = rank_cuts(df, seed, sizes, expected_rows=expected_rows).orderBy("fraction").collect()
    inside = F.array_compact(F.array(*[F.when(F.col("_at") <= _place(c), F.lit(c["fraction"])) for c in cuts])) if cuts else F.array().cast("array<double>")
    return df.withColumn("_at", seeded_place(seed)).withColumn("fraction", F.explode(inside)).drop("_at")


def data_fractions(
    train: DataFrame, seed: int, fractions: Sequence[float] = LARGE_TIER_FRACTIONS
) -> DataFrame:
    """Nested random subsets for the early rungs of a large-tier search."""
    return nested_fractions(train, fractions, seed + INNER_SEED_OFFSET, minimum=1)


def fold_sides(folded: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) of one fold."""
    return folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold)


def join_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Attach stored folds to rows by key."""
    return df.join(folds.select("row_id", "fold"), "row_id")


def split_violations(folds: DataFrame, rows: DataFrame) -> DataFrame:
    """Keys that are in no fold, in several folds, or unknown to the data."""
    assigned = folds.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_folds"))
    present = rows.select("row_id", F.lit(1).alias("known"))
    return (
        assigned.join(present, "row_id", "full_outer")
        .filter(F.col("n_folds").isNull() | F.col("known").isNull() | (F.col("n_folds") != 1))
        .select("row_id", F.coalesce("n_folds", F.lit(0)).cast("long").alias("n_folds"))
    )
