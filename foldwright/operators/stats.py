"""Statistical comparison of paired scores, many comparisons in one job."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.functions.scalar import normal_tail_sql
from foldwright.operators.ordering import grouped_quantiles, prefix_sums

TIE_TOLERANCE = 1e-9
CLOSE_TOLERANCE = 1e-8
SIGNIFICANCE = 0.05
EXACT_LIMIT = 50
MIN_PAIRS = 3
MIN_BLOCKS = 3


def significant(p: Column) -> Column:
    return p < SIGNIFICANCE


def win_tie_loss(pairs: DataFrame, keys: Sequence[str], tolerance: float = TIE_TOLERANCE) -> DataFrame:
    """Blocks where ``a`` beats, ties or loses to ``b``."""
    delta = F.col("a") - F.col("b")
    count = lambda cond: F.sum(cond.cast("long"))
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("blocks"),
        count(delta > tolerance).alias("win"),
        count(F.abs(delta) <= tolerance).alias("tie"),
        count(delta < -tolerance).alias("loss"),
    )


def signed_ranks(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per distinct |delta|: counts by sign and the tie-averaged rank.

    Zero differences are left out. One row per distinct size instead of one per
    pair; the ranks come from bucketed prefix sums.
    """
    delta = F.col("a") - F.col("b")
    sizes = (
        pairs.select(*keys, delta.alias("delta"))
        .filter(F.abs("delta") > CLOSE_TOLERANCE)
        .groupBy(*keys, F.abs("delta").alias("size"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum((F.col("delta") > 0).cast("long")).alias("n_positive"),
        )
    )
    ranked = prefix_sums(sizes, keys, "size", ["n"])
    return ranked.withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2)


@lru_cache(maxsize=None)
def _exact_tail(n: int) -> tuple[float, ...]:
    """P(W <= w) for w = 0..n(n+1)/2 under random signs, by counting subset sums."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for rank in range(1, n + 1):
        ways[rank:] = ways[rank:] + ways[:-rank].copy()
    return tuple(np.cumsum(ways) / 2.0**n)


def exact_wilcoxon_table(spark: SparkSession, sizes: Sequence[int]) -> DataFrame:
    """(n, w, cdf) for the asked sample sizes, at most n = 50: a bounded lookup table."""
    rows = [
        (n, w, float(p)) for n in sizes if n <= EXACT_LIMIT for w, p in enumerate(_exact_tail(n))
    ]
    return spark.createDataFrame(rows, "n_used long, w_key long, cdf double")


def wilcoxon_statistics(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, median delta, rank sums, tie terms and rank-biserial effect per comparison."""
    delta = pairs.withColumn("delta", F.col("a") - F.col("b"))
    base = delta.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.abs("delta") > CLOSE_TOLERANCE).cast("long")).alias("n_used"),
    )
    medians = grouped_quantiles(delta, keys, "delta", {"median_delta": 0.5})
    ranks = signed_ranks(pairs, keys).groupBy(*keys).agg(
        F.sum(F.col("rank") * F.col("n_positive")).alias("r_plus"),
        F.sum(F.col("rank") * F.col("n")).alias("r_total"),
        F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("tie_term"),
    )
    all_close = F.col("n_used") == 0
    return (
        base.join(medians, list(keys))
        .join(ranks, list(keys), "left")
        .select(
            *keys,
            "n",
            "n_used",
            F.when(all_close, 0.0).otherwise(F.col("median_delta")).alias("median_delta"),
            F.coalesce("r_plus", F.lit(0.0)).alias("r_plus"),
            F.coalesce("r_total", F.lit(0.0)).alias("r_total"),
            F.coalesce("tie_term", F.lit(0)).alias("tie_term"),
            F.when(all_close, 0.0)
            .otherwise(F.try_divide(2 * F.col("r_plus"), F.col("r_total")) - 1)
            .alias("effect_size"),
        )
    )


def normal_p(stats: DataFrame) -> DataFrame:
    """Two-sided p from the normal approximation with tie correction."""
    n = F.col("n_used")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48
    smaller = F.least("r_plus", F.col("r_total") - F.col("r_plus"))
    z = F.try_divide(smaller - n * (n + 1) / 4, F.sqrt(variance))
    return (
        stats.withColumn("_z", z)
        .withColumn(
            "p_normal",
            F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.expr(normal_tail_sql("_z")))),
        )
        .drop("_z")
    )


def paired_wilcoxon(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wilcoxon signed-rank test per comparison (pairs have columns a and b).

    The exact null is used up to 50 pairs without ties or zeros, the normal
    approximation elsewhere. Fewer than three pairs give NULL results and a note.
    """
    stats = normal_p(wilcoxon_statistics(pairs, keys))
    spark = pairs.sparkSession
    # Only sample sizes up to 50 have an exact entry; asking for all of them keeps this lazy.
    exact = exact_wilcoxon_table(spark, range(1, EXACT_LIMIT + 1))
    plain = (F.col("tie_term") == 0) & (F.col("n_used") == F.col("n")) & (F.col("n") <= EXACT_LIMIT)
    smaller = F.least("r_plus", F.col("r_total") - F.col("r_plus"))
    keyed = stats.withColumn("w_key", F.when(plain, F.floor(smaller)))
    joined = keyed.join(F.broadcast(exact), ["n_used", "w_key"], "left")
    p = F.when(F.col("cdf").isNotNull(), F.least(F.lit(1.0), 2 * F.col("cdf"))).otherwise(
        F.col("p_normal")
    )
    enough = F.col("n") >= MIN_PAIRS
    return joined.select(
        *keys,
        "n",
        F.when(enough, F.col("median_delta")).alias("median_delta"),
        F.when(enough, p).alias("p_value"),
        F.when(enough, F.col("effect_size")).alias("effect_size"),
        F.when(enough, significant(p)).alias("significant"),
        F.when(~enough, F.lit(f"too few pairs to test: at least {MIN_PAIRS} are wanted")).alias("note"),
    )


def block_ranks(scores: DataFrame, block: Sequence[str], treatment: str, value: str) -> DataFrame:
    """Descending rank of each treatment inside a block, ties averaged.

    A block holds one row per treatment, so the window is small.
    """
    by_value = Window.partitionBy(*block).orderBy(F.desc(value))
    same = Window.partitionBy(*block, value)
    return scores.withColumn(
        "rank", F.rank().over(by_value) + (F.count(F.lit(1)).over(same) - 1) / 2
    )


def average_ranks(ranks: DataFrame, treatment: str) -> DataFrame:
    return ranks.groupBy(treatment).agg(F.avg("rank").alias("average_rank"))


def chi2_tail(statistic: Column, df: Column) -> Column:
    """P(X > statistic) for chi-square with ``df`` degrees of freedom.

    Finite sums: even df is a Poisson sum, odd df adds half-integer terms to the
    normal tail. Works per row for any df up to 60.
    """
    half = statistic / 2
    even_terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.floor(df / 2).cast("int") - 1, F.lit(1))),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] * half / i).alias("term"),
            (acc["total"] + F.when(df >= 4, acc["term"] * half / i).otherwise(0.0)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    odd_terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.floor((df - 1) / 2).cast("int"), F.lit(1))),
        F.struct(
            (F.exp(-half) / F.sqrt(F.lit(math.pi) * F.when(half > 0, half))).alias("term"),
            F.lit(0.0).alias("total"),
        ),
        lambda acc, i: F.struct(
            (acc["term"] * half / (i - 0.5)).alias("term"),
            (acc["total"] + F.when(df >= 3, acc["term"] * half / (i - 0.5)).otherwise(0.0)).alias(
                "total"
            ),
        ),
        lambda acc: acc["total"],
    )
    # The tail of sqrt(statistic) is written on a plain column by the caller.
    return F.when(df % 2 == 0, F.exp(-half) * even_terms).otherwise(
        2 * F.col("_normal_tail") + F.coalesce(odd_terms, F.lit(0.0))
    )


def friedman(
    scores: DataFrame, block: Sequence[str], treatment: str, value: str
) -> DataFrame:
    """One row: blocks, treatments, chi2 with tie correction, p, significance, note.

    Blocks that lack a treatment are left out.
    """
    k_all = scores.select(treatment).distinct().agg(F.count(F.lit(1)).alias("k")).scalar()
    full = scores.groupBy(*block).agg(F.count(value).alias("_k")).filter(F.col("_k") == k_all)
    ranks = block_ranks(scores.join(full.select(*block), list(block)), block, treatment, value)
    per_treatment = ranks.groupBy(treatment).agg(
        F.sum("rank").alias("rank_sum"), F.count(F.lit(1)).alias("n")
    )
    ties = ranks.groupBy(*block, value).agg(F.count(F.lit(1)).alias("t")).agg(
        F.coalesce(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")), F.lit(0)).alias("ties")
    )
    totals = per_treatment.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("blocks"),
        F.count(F.lit(1)).alias("treatments"),
        F.sum(F.col("rank_sum") * F.col("rank_sum")).alias("ss"),
    ).withColumn("ties", ties.scalar())
    n, k = F.col("blocks"), F.col("treatments")
    plain = 12 * F.col("ss") / (n * k * (k + 1)) - 3 * n * (k + 1)
    correction = 1 - F.col("ties") / (n * (k * k * k - k))
    enough = (n >= MIN_BLOCKS) & (k >= 3)
    tested = totals.withColumn("chi2", F.when(enough, plain / F.nullif(correction, F.lit(0.0))))
    tested = tested.withColumn("_root", F.sqrt("chi2")).withColumn(
        "_normal_tail", F.expr(normal_tail_sql("_root"))
    )
    p = F.when(enough, F.coalesce(chi2_tail(F.col("chi2"), k - 1), F.lit(1.0)))
    return tested.withColumn("p_value", p).select(
        "blocks",
        "treatments",
        "chi2",
        "p_value",
        significant(F.col("p_value")).alias("significant"),
        F.when(
            ~enough,
            F.format_string("%d blocks of %d treatments are too few to test: three of each are wanted", n, k),
        ).alias("note"),
    )


@lru_cache(maxsize=None)
def _studentised_range_grid(k: int, points: int = 601) -> tuple[tuple[float, float], ...]:
    """(q, P(range of k normals > q)) on a grid 0..12, by quadrature."""
    z = np.linspace(-8.0, 8.0, 1601)
    weight = np.full(z.size, z[1] - z[0])
    weight[[0, -1]] /= 2
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    out = []
    for q in np.linspace(0.0, 12.0, points):
        shifted = np.array([0.5 * math.erfc(-(v - q) / math.sqrt(2)) for v in z])
        inside = k * np.sum(weight * density * np.clip(cdf - shifted, 0, 1) ** (k - 1))
        out.append((float(q), float(min(1.0, max(0.0, 1.0 - inside)))))
    return tuple(out)


def nemenyi(
    scores: DataFrame, block: Sequence[str], treatment: str, value: str, treatments: int
) -> DataFrame:
    """Pairwise post-hoc: rank gap, statistic q and p from the studentised range.

    Treatments are modes of a study (a handful), so pairing them is bounded by
    k(k-1)/2 rows; p is interpolated from a fixed grid table.
    """
    ranks = block_ranks(scores, block, treatment, value)
    means = ranks.groupBy(treatment).agg(
        F.avg("rank").alias("average_rank"), F.count(F.lit(1)).alias("n")
    )
    left = means.select(F.col(treatment).alias("a"), F.col("average_rank").alias("rank_a"), "n")
    right = means.select(F.col(treatment).alias("b"), F.col("average_rank").alias("rank_b"))
    k = float(treatments)
    gap = F.abs(F.col("rank_a") - F.col("rank_b"))
    pairs = left.join(right, F.col("a") < F.col("b")).select(
        "a", "b", gap.alias("gap"), (gap / F.sqrt(F.lit(k * (k + 1)) / (12.0 * F.col("n")))).alias("q")
    )
    grid = _studentised_range_grid(treatments)
    step = grid[1][0]
    tail = F.array(*[F.lit(p) for _, p in grid])
    cell = F.least(F.floor(F.col("q") / step), F.lit(len(grid) - 2)).cast("int")
    low, high = F.get(tail, cell), F.get(tail, cell + 1)
    share = F.least(F.col("q") / step - cell, F.lit(1.0))
    return pairs.withColumn("p_value", low + (high - low) * share)
