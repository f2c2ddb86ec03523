"""Queries over paired scores: tests, ranks and post-hoc comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.catalog.base import query
from foldwright.functions import scalar
from foldwright.operators import stats
from foldwright.sources.datasets import table

# Pairs: per (supplier, customer-month) style blocks two scores from exact integer sums.
_PAIRS = """pairs AS (SELECT l_returnflag || l_linestatus AS comparison, l_suppkey AS block,
  sum(cast(round(l_discount * 100) AS BIGINT)) / (count(*) * 100e0) AS a,
  sum(cast(round(l_tax * 100) AS BIGINT)) / (count(*) * 80e0) AS b FROM lineitem GROUP BY ALL)"""


def pairs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    n = F.count(F.lit(1))
    return li.groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("comparison"), F.col("l_suppkey").alias("block")
    ).agg(
        (F.sum(F.round(F.col("l_discount") * 100).cast("long")) / (n * 100)).alias("a"),
        (F.sum(F.round(F.col("l_tax") * 100).cast("long")) / (n * 80)).alias("b"),
    )


@query("test_win_tie_loss", """SELECT l_suppkey AS comparison, count(*) AS blocks,
  count(*) FILTER (d > 1e-9) AS win, count(*) FILTER (abs(d) <= 1e-9) AS tie, count(*) FILTER (d < -1e-9) AS loss
  FROM (SELECT l_suppkey, l_discount - l_tax AS d FROM lineitem) GROUP BY 1""")
def win_tie_loss(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("comparison"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return stats.win_tie_loss(li, ["comparison"])


_RANKED = """r AS (SELECT comparison, d, abs(d) AS size, rank() OVER (PARTITION BY comparison ORDER BY abs(d))
    + (count(*) OVER (PARTITION BY comparison, abs(d)) - 1) / 2e0 AS rk FROM (SELECT comparison, a - b AS d
    FROM pairs) WHERE abs(d) > 1e-8)"""


@query("test_signed_ranks", f"""WITH {_PAIRS}, {_RANKED} SELECT comparison, round(size, 9) AS size, count(*) AS n,
  cast(sum((d > 0)::INT) AS BIGINT) AS n_positive, max(rk) AS rank FROM r GROUP BY comparison, size""")
def signed_ranks(spark, sf_dir):
    out = stats.signed_ranks(pairs(spark, sf_dir), ["comparison"])
    return out.select("comparison", F.round("size", 9).alias("size"), "n", "n_positive", "rank")


_WILCOXON = f"""base AS (SELECT comparison, count(*) AS n, quantile_cont(a - b, 0.5) AS median_delta FROM pairs GROUP BY 1),
  t AS (SELECT comparison, sum(n * n * n - n) AS ties, sum(n) AS m FROM (SELECT comparison, size, count(*) AS n FROM r
    GROUP BY 1, 2) GROUP BY 1),
  w AS (SELECT comparison, sum(rk) FILTER (d > 0) AS r_plus, sum(rk) AS r_total FROM r GROUP BY 1),
  z AS (SELECT comparison, n, m, median_delta, r_plus, r_total, ties, (least(r_plus, r_total - r_plus)
    - m * (m + 1) / 4e0) / sqrt(m * (m + 1) * (2e0 * m + 1) / 24 - ties / 48e0) AS z
    FROM base JOIN t USING (comparison) JOIN w USING (comparison))"""


@query("test_wilcoxon_statistics", f"""WITH {_PAIRS}, {_RANKED}, {_WILCOXON} SELECT comparison, n, cast(m AS BIGINT) AS n_used,
  round(median_delta, 6) AS median_delta, r_plus, round(2 * r_plus / r_total - 1, 6) AS effect_size,
  round(least(1e0, 2 * {scalar.normal_tail_sql('z')}), 6) AS p_normal FROM z""")
def wilcoxon_statistics(spark, sf_dir):
    out = stats.normal_p(stats.wilcoxon_statistics(pairs(spark, sf_dir), ["comparison"]))
    return out.select("comparison", "n", "n_used", F.round("median_delta", 6).alias("median_delta"), "r_plus",
                      F.round("effect_size", 6).alias("effect_size"), F.round("p_normal", 6).alias("p_normal"))


@query("test_paired_wilcoxon", f"""WITH {_PAIRS}, {_RANKED}, {_WILCOXON} SELECT comparison, n,
  round(median_delta, 6) AS median_delta, round(2 * r_plus / r_total - 1, 6) AS effect_size,
  2 * {scalar.normal_tail_sql('z')} < 0.05e0 AS significant FROM z""")
def paired_wilcoxon(spark, sf_dir):
    out = stats.paired_wilcoxon(pairs(spark, sf_dir), ["comparison"])
    return out.select("comparison", "n", F.round("median_delta", 6).alias("median_delta"),
                      F.round("effect_size", 6).alias("effect_size"), "significant")


# Blocks: parts; treatments: three kinds of line, scored by exact integer ratios.
_BLOCKS = """blocks AS (SELECT block, mode, max(d) AS score FROM (SELECT l_partkey AS block,
  ['automated', 'baseline_default', 'baseline_expert'][l_suppkey % 3 + 1] AS mode,
  cast(round(l_discount * 100) AS BIGINT) AS d FROM lineitem) GROUP BY ALL)"""
_RANKS = """full_blocks AS (SELECT block FROM blocks GROUP BY 1 HAVING count(*) = 3),
  rk AS (SELECT block, mode, score, rank() OVER (PARTITION BY block ORDER BY score DESC)
    + (count(*) OVER (PARTITION BY block, score) - 1) / 2e0 AS rank FROM blocks JOIN full_blocks USING (block))"""


def blocks(spark, sf_dir):
    from foldwright.sources.datasets import MODES

    mode = F.element_at(F.array(*[F.lit(m) for m in MODES]), (F.col("l_suppkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_partkey").alias("block"), mode.alias("mode")
    ).agg(F.max(F.round(F.col("l_discount") * 100).cast("long")).alias("score"))


def complete(scores):
    """Blocks that have all three modes."""
    full = scores.groupBy("block").agg(F.count(F.lit(1)).alias("k")).filter("k = 3").select("block")
    return scores.join(full, "block")


@query("test_block_ranks", f"WITH {_BLOCKS}, {_RANKS} SELECT block, mode, rank FROM rk")
def block_ranks(spark, sf_dir):
    ranked = stats.block_ranks(complete(blocks(spark, sf_dir)), ["block"], "mode", "score")
    return ranked.select("block", "mode", "rank")


@query("test_average_ranks", f"WITH {_BLOCKS}, {_RANKS} SELECT mode, round(avg(rank), 6) AS average_rank FROM rk GROUP BY 1")
def average_ranks(spark, sf_dir):
    ranked = stats.block_ranks(complete(blocks(spark, sf_dir)), ["block"], "mode", "score")
    return stats.average_ranks(ranked, "mode").select("mode", F.round("average_rank", 6).alias("average_rank"))


@query("test_friedman", f"""WITH {_BLOCKS}, {_RANKS}, s AS (SELECT mode, sum(rank) AS rs, count(*) AS n FROM rk GROUP BY 1),
  t AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*) AS t FROM rk GROUP BY block, score)),
  c AS (SELECT max(n) AS n, (12 * sum(rs * rs) / (max(n) * 12e0) - 12e0 * max(n))
    / (1 - max(ties) / (max(n) * 24e0)) AS chi2 FROM s, t)
  SELECT n AS blocks, cast(3 AS BIGINT) AS treatments, round(chi2, 5) AS chi2, round(exp(-chi2 / 2), 6) AS p_value,
  exp(-chi2 / 2) < 0.05e0 AS significant FROM c""")
def friedman(spark, sf_dir):
    out = stats.friedman(blocks(spark, sf_dir), ["block"], "mode", "score")
    return out.select("blocks", "treatments", F.round("chi2", 5).alias("chi2"),
                      F.round("p_value", 6).alias("p_value"), "significant")


@query("test_nemenyi_statistic", f"""WITH {_BLOCKS}, {_RANKS}, m AS (SELECT mode, avg(rank) AS r, count(*) AS n FROM rk GROUP BY 1)
  SELECT x.mode AS a, y.mode AS b, round(abs(x.r - y.r), 6) AS gap, round(abs(x.r - y.r) / sqrt(12e0 / (12e0 * x.n)), 5) AS q
  FROM m x JOIN m y ON x.mode < y.mode""")
def nemenyi(spark, sf_dir):
    out = stats.nemenyi(complete(blocks(spark, sf_dir)), ["block"], "mode", "score", 3)
    return out.select("a", "b", F.round("gap", 6).alias("gap"), F.round("q", 5).alias("q"))


@query("test_nemenyi_p_values")
def nemenyi_p(spark, sf_dir):
    return stats.nemenyi(complete(blocks(spark, sf_dir)), ["block"], "mode", "score", 3)
