"""Queries over study tables: plans, gating, resume, search space, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.catalog.base import query
from foldwright.catalog.data import MEASURED, NAMES, measured_registry
from foldwright.catalog.fixtures import CTE, with_cte
from foldwright.functions import scalar

from foldwright.plans import report, search
from foldwright.sources import config
from foldwright.sources.datasets import study_runs, table


def _values(rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        return f"'{v}'" if isinstance(v, str) else f"{v!r}"

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


_RANK = "CASE {} WHEN 'small' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
_LIMITS = "limits(model, max_tier, regression_only) AS (VALUES " + _values(
    (m, t, m == "lasso") for m, t in config.MAX_TIER.items()) + ")"
_GRID = f"""{MEASURED}, {_LIMITS}, grid AS (SELECT name AS dataset, task, tier, model, seed, mode,
  CASE WHEN {_RANK.format('tier')} > {_RANK.format('max_tier')} THEN 'tier-gated'
    WHEN regression_only AND task = 'classification' THEN 'task-mismatch' END AS reason
  FROM tiers, limits, (SELECT unnest([42, 43]) AS seed), (SELECT unnest(['automated', 'baseline_default',
  'baseline_expert']) AS mode))"""


def _grid(spark, sf_dir):
    reg = measured_registry(spark, sf_dir)
    sweep = config.sweep_config(spark, "own", [42, 43], list(NAMES), list(config.MAX_TIER))
    return config.gate(config.sweep_grid(sweep), reg, config.model_limits(spark))


@query("sweep_grid_gated", with_cte(*NAMES, extra=_GRID) + "SELECT dataset, model, seed, mode, task, tier, reason FROM grid")
def sweep_grid_gated(spark, sf_dir):
    return _grid(spark, sf_dir).select("dataset", "model", "seed", "mode", "task", "tier", "reason")


@query("sweep_config_counts", with_cte(*NAMES, extra=_GRID) + """SELECT dataset, count(*) AS planned,
  count(DISTINCT model) AS models, count(DISTINCT mode) AS modes FROM grid GROUP BY 1""")
def sweep_config_counts(spark, sf_dir):
    return _grid(spark, sf_dir).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("planned"), F.count_distinct("model").alias("models"),
        F.count_distinct("mode").alias("modes"))


@query("outcome_counts", with_cte(*NAMES, extra=_GRID) + """SELECT status, count(*) AS n, status = 'failed' AS failure
  FROM (SELECT CASE WHEN reason IS NOT NULL THEN 'skipped_gated' WHEN mode = 'automated' THEN 'skipped_existing'
  ELSE 'completed' END AS status FROM grid) GROUP BY 1""")
def outcome_counts(spark, sf_dir):
    from foldwright.plans.benchmark import outcome_summary

    status = F.when(F.col("reason").isNotNull(), "skipped_gated").when(
        F.col("mode") == "automated", "skipped_existing").otherwise("completed")
    return outcome_summary(_grid(spark, sf_dir).withColumn("status", status))


# Planned runs per order line group, finished ones from another slice of the same table.
_PLANNED = """planned AS (SELECT DISTINCT l_returnflag || l_linestatus AS dataset, 'm' || l_linenumber AS model,
    cast(l_suppkey AS INTEGER) AS seed, 'automated' AS mode, 'smoke' AS budget_profile, 'full' AS data_variant FROM lineitem),
  finished AS (SELECT DISTINCT l_returnflag || l_linestatus AS dataset, 'm' || l_linenumber AS model, cast(l_suppkey AS INTEGER)
    AS seed, 'automated' AS mode, 'smoke' AS budget_profile, CASE WHEN l_linenumber = 3 THEN 'local_subset' ELSE 'full' END
    AS data_variant FROM lineitem WHERE l_discount > 0.095e0)"""


def _plan_tables(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    common = [
        F.concat("l_returnflag", "l_linestatus").alias("dataset"),
        F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"),
        F.col("l_suppkey").cast("int").alias("seed"),
        F.lit("automated").alias("mode"),
        F.lit("smoke").alias("budget_profile"),
    ]
    variant = F.when(F.col("l_linenumber") == 3, "local_subset").otherwise("full")
    planned = li.select(*common, F.lit("full").alias("data_variant")).distinct()
    finished = li.filter(F.col("l_discount") > 0.095).select(*common, variant.alias("data_variant")).distinct()
    return planned, finished


@query("resume_remaining_runs", f"""WITH {_PLANNED} SELECT dataset, model, seed, mode, budget_profile, data_variant FROM planned
  EXCEPT SELECT dataset, model, seed, mode, budget_profile, data_variant FROM finished""")
def resume_remaining(spark, sf_dir):
    return config.remaining(*_plan_tables(spark, sf_dir)).select(*config.RESUME_KEYS)


@query("resume_finished_runs", f"""WITH {_PLANNED} SELECT dataset, model, seed, mode, budget_profile, data_variant FROM planned
  INTERSECT SELECT dataset, model, seed, mode, budget_profile, data_variant FROM finished""")
def resume_finished(spark, sf_dir):
    return config.already_done(*_plan_tables(spark, sf_dir)).select(*config.RESUME_KEYS)


_EXPERT = "expert(scope, key, model, param, value) AS (VALUES " + _values(config.EXPERT_PARAMS) + """,
  ('dataset', 'line_cls', 'xgboost', 'model.max_depth', '8'), ('dataset', 'line_cls', 'xgboost', 'model.extra', '1'))"""


@query("expert_params_resolved", with_cte(*NAMES, extra=f"""{_GRID}, {_EXPERT}, b AS (SELECT DISTINCT dataset, task, model FROM grid),
  d AS (SELECT dataset, b.model, param, value FROM b JOIN expert e ON scope = 'task' AND key = task AND e.model = b.model),
  o AS (SELECT dataset, b.model, param, value FROM b JOIN expert e ON scope = 'dataset' AND key = dataset AND e.model = b.model)""")
  + """SELECT coalesce(d.dataset, o.dataset) AS dataset, coalesce(d.model, o.model) AS model, coalesce(d.param, o.param) AS param,
  coalesce(o.value, d.value) AS value FROM d FULL JOIN o ON d.dataset = o.dataset AND d.model = o.model AND d.param = o.param""")
def expert_params_resolved(spark, sf_dir):
    rows = [*config.EXPERT_PARAMS, ("dataset", "line_cls", "xgboost", "model.max_depth", "8"),
            ("dataset", "line_cls", "xgboost", "model.extra", "1")]
    return config.resolve_expert(config.expert_params(spark, rows), _grid(spark, sf_dir))


@query("budget_per_dataset", with_cte(*NAMES, extra=f"""{MEASURED}, budgets(profile, tier, n_trials, timeout_s, inner_folds) AS
  (VALUES {_values(config.BUDGETS)})""") + """SELECT name, tier, profile, n_trials, timeout_s, inner_folds FROM tiers JOIN budgets USING (tier)""")
def budget_per_dataset(spark, sf_dir):
    reg = measured_registry(spark, sf_dir).select("name", "tier")
    return reg.join(F.broadcast(config.budgets(spark)), "tier").select(
        "name", "tier", "profile", "n_trials", "timeout_s", "inner_folds")


_SPACE_COLS = ("model, param, kind, low, high, step, choices, depends_on, depends_value, task, tier, needs_cat")
_SPACE = f"space({_SPACE_COLS}) AS (VALUES {_values(config.space_rows())})"
_TARGETS = """targets AS (SELECT name AS dataset, task, tier, name NOT IN ('event_std', 'embed_cls10') AS has_categorical,
   m.model FROM tiers, (SELECT unnest(['linear', 'lasso', 'sgd_linear', 'random_forest', 'extra_trees', 'hist_gb', 'svm',
   'knn', 'xgboost', 'torch_mlp']) AS model) m),
  fit AS (SELECT t.dataset, t.model, t.task, t.tier, t.has_categorical, param, kind, low, high, step, choices, depends_on,
    depends_value FROM targets t JOIN space s ON coalesce(s.model, t.model) = t.model AND coalesce(s.task, t.task) = t.task
    AND coalesce(s.tier, t.tier) = t.tier AND (NOT needs_cat OR has_categorical))"""


def _space(spark, sf_dir):
    reg = measured_registry(spark, sf_dir).select(F.col("name").alias("dataset"), "task", "tier")
    models = F.explode(F.array(*[F.lit(m) for m in config.MAX_TIER])).alias("model")
    targets = reg.select(
        "dataset", "task", "tier", (~F.col("dataset").isin("event_std", "embed_cls10")).alias("has_categorical"), models)
    return config.search_space(spark, targets)


@query("search_space_per_dataset", with_cte(*NAMES, extra=f"{MEASURED}, {_SPACE}, {_TARGETS}") + """SELECT dataset, model, param, kind,
  cast(low AS DOUBLE) AS low, cast(high AS DOUBLE) AS high, cast(len(choices) AS INTEGER) AS n_choices, depends_value FROM fit""")
def search_space(spark, sf_dir):
    n = F.when(F.col("choices").isNotNull(), F.size("choices"))
    return _space(spark, sf_dir).select(
        "dataset", "model", "param", "kind", "low", "high", n.alias("n_choices"), "depends_value")


@query("sampled_trials", with_cte(*NAMES, extra=f"""{MEASURED}, {_SPACE}, {_TARGETS},
  d AS MATERIALIZED (SELECT dataset, model, param, depends_on, depends_value, trial, kind, choices, cast(low AS DOUBLE) AS low, cast(high AS DOUBLE) AS high,
    cast(step AS DOUBLE) AS step, cast(('0x' || substr(md5('7:' || trial || ':' || param), 1, 7)) AS BIGINT) / 268435456e0 AS u
    FROM fit, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS trial)),
  v AS MATERIALIZED (SELECT *, CASE kind WHEN 'categorical' THEN choices[cast(floor(u * len(choices)) AS INTEGER) + 1]
    WHEN 'int' THEN cast(cast(low + step * floor(u * (floor((high - low) / step) + 1)) AS BIGINT) AS VARCHAR)
    WHEN 'fixed' THEN cast(cast(low AS BIGINT) AS VARCHAR) END AS value,
    CASE kind WHEN 'log' THEN exp(ln(low) + u * (ln(high) - ln(low))) WHEN 'float' THEN low + u * (high - low) END AS number FROM d)""")
  + """SELECT a.dataset, a.model, a.trial, a.param, a.value, round(a.number, 6) AS number
  FROM v a LEFT JOIN (SELECT DISTINCT dataset, model, trial, param, value FROM v) b
    ON b.dataset = a.dataset AND b.model = a.model AND b.trial = a.trial AND b.param = a.depends_on AND b.value = a.depends_value
  WHERE a.depends_on IS NULL OR b.param IS NOT NULL""")
def sampled_trials(spark, sf_dir):
    space = _space(spark, sf_dir)
    values = search.sample_values(space, 6, 7)
    kinds = space.select("dataset", "model", "param", "kind")
    real = F.col("kind").isin("log", "float")
    return values.join(kinds, ["dataset", "model", "param"]).select(
        "dataset", "model", "trial", "param", F.when(~real, F.col("value")).alias("value"),
        F.when(real, F.round(F.col("value").cast("double"), 6)).alias("number"))


# Trials: per supplier a study, per line number a trial, three steps.
_STEPS = """steps AS (SELECT l_suppkey AS study, l_linenumber AS trial, cast(l_partkey % 3 AS INTEGER) AS step,
  sum(cast(round(l_discount * 100) AS BIGINT)) / (count(*) * 100e0) AS reported FROM lineitem GROUP BY ALL)"""


def _steps(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("study"), F.col("l_linenumber").alias("trial"),
        (F.col("l_partkey") % 3).cast("int").alias("step")
    ).agg((F.sum(F.round(F.col("l_discount") * 100).cast("long")) / (F.count(F.lit(1)) * 100)).alias("reported"))


@query("prune_by_median", f"""WITH {_STEPS}, s AS (SELECT *, max(reported) OVER (PARTITION BY study, trial ORDER BY step) AS best FROM steps),
  m AS (SELECT a.study, a.trial, a.step, any_value(a.best) AS best, quantile_cont(b.reported, 0.5) AS median, count(b.trial) AS n_earlier
    FROM s a LEFT JOIN s b ON a.study = b.study AND a.step = b.step AND b.trial < a.trial GROUP BY ALL)
  SELECT study, trial, step, n_earlier >= 4 AND step >= 1 AND coalesce(best < median, false) AS pruned FROM m""")
def prune_by_median(spark, sf_dir):
    marked = search.median_prune(_steps(spark, sf_dir), ["study"])
    return marked.select("study", "trial", "step", F.coalesce("pruned", F.lit(False)).alias("pruned"))


@query("prune_by_halving", f"""WITH {_STEPS} SELECT study, trial, step AS rung, row_number() OVER w AS place,
  row_number() OVER w <= greatest(floor(count(*) OVER (PARTITION BY study, step) / 4), 1) AS survives FROM steps
  WINDOW w AS (PARTITION BY study, step ORDER BY reported DESC, trial)""")
def prune_by_halving(spark, sf_dir):
    rungs = _steps(spark, sf_dir).withColumnsRenamed({"step": "rung", "reported": "value"})
    return search.successive_halving(rungs, ["study"]).select(
        "study", "trial", "rung", F.col("place").cast("long").alias("place"), "survives")


@query("best_trial_per_study", f"""WITH {_STEPS}, t AS (SELECT study, trial, max(reported) AS value FROM steps GROUP BY 1, 2)
  SELECT study, trial, value, 'x' || trial AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY value DESC, trial) AS rn FROM t) WHERE rn = 1""")
def best_trial(spark, sf_dir):
    trials = _steps(spark, sf_dir).groupBy("study", "trial").agg(F.max("reported").alias("value"))
    mapped = trials.withColumn(
        "params", F.create_map(F.lit("model.alpha"), F.concat(F.lit("x"), F.col("trial").cast("string"))))
    best = search.best_trial(mapped, ["study"])
    return best.select("study", "trial", "value", F.col("params")["model.alpha"].alias("chosen"))


# ---------------------------------------------------------------- run store as key/value rows

_STORE = f"""runs AS ({CTE['runs']})"""
_MODE_LABEL = "CASE mode WHEN 'automated' THEN 'Automated' WHEN 'baseline_default' THEN 'Defaults' WHEN 'baseline_expert' THEN 'Expert' ELSE mode END"


def _store(spark, sf_dir):
    """The derived runs as run, tag, parameter and metric rows (as a run store holds them)."""
    tidy = study_runs(spark, sf_dir)
    runs = tidy.select("run_id", F.when(F.col("seed") == 44, "FAILED").otherwise("FINISHED").alias("status"))
    tags = tidy.withColumn("benchmark_mode", F.when(F.col("model") != "xgboost", F.col("mode"))).unpivot(
        "run_id", ["dataset", "model", "benchmark_mode", "tier", "task"], "name", "value").filter("value IS NOT NULL")
    params = tidy.select("run_id", F.lit("seed").alias("name"), F.col("seed").cast("string").alias("value"))
    names = ["roc_auc_mean", "neg_rmse_mean", "ece_mean", "fit_seconds_mean"]
    metric_rows = tidy.unpivot("run_id", names, "name", "value").filter("value IS NOT NULL").withColumn(
        "step", F.lit(None).cast("int"))
    return runs, tags, params, metric_rows


@query("runs_tidy", f"""WITH {_STORE} SELECT run_id, dataset, model, mode, seed, tier, task, roc_auc_mean, neg_rmse_mean, ece_mean,
  fit_seconds_mean, "primary" FROM runs WHERE seed <> 44 AND model <> 'xgboost'""")
def runs_tidy(spark, sf_dir):
    return report.tidy_runs(*_store(spark, sf_dir))


@query("runs_filter_conjunctive", f"""WITH {_STORE} SELECT run_id FROM runs WHERE dataset = 'ds_RF' AND model = 'linear' AND mode = 'automated' AND seed <> 44""")
def runs_filter(spark, sf_dir):
    from foldwright.sources.runstore import find_runs

    runs, tags, _, _ = _store(spark, sf_dir)
    return find_runs(runs, tags, {"dataset": "ds_RF", "model": "linear", "benchmark_mode": "automated"})


@query("runs_scaling", """SELECT dataset, model, fraction, n_rows, primary_ AS "primary", fit_seconds, fit_peak_mb FROM (
  SELECT l_returnflag AS dataset, 'm' || l_linenumber AS model, l_suppkey / 100e0 AS fraction, count(*) AS n_rows,
  sum(cast(l_quantity AS BIGINT)) / count(*)::DOUBLE AS primary_, count(*) / 10e0 AS fit_seconds, 1e0 AS fit_peak_mb
  FROM lineitem GROUP BY l_returnflag, l_linenumber, l_suppkey)""")
def runs_scaling(spark, sf_dir):
    n = F.count(F.lit(1))
    points = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("dataset"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"), "l_suppkey"
    ).agg(n.cast("double").alias("n_train_rows"), (F.sum(F.col("l_quantity").cast("long")) / n).alias("primary"),
          (n / 10).alias("fit_seconds"), F.lit(1.0).alias("fit_peak_mb")
    ).withColumns({
        "run_id": F.concat_ws("/", "dataset", "model", F.col("l_suppkey").cast("string")), "scaling": F.lit("true"),
        "scaling_fraction": (F.col("l_suppkey") / 100).cast("string")})
    runs = points.select("run_id", F.lit("FINISHED").alias("status"))
    tags = points.unpivot("run_id", ["dataset", "model", "scaling", "scaling_fraction"], "name", "value")
    metric_rows = points.unpivot("run_id", ["n_train_rows", "primary", "fit_seconds", "fit_peak_mb"], "name", "value")
    return report.scaling_runs(runs, tags, metric_rows)


@query("quality_metric_filter", """SELECT name, count(*) AS n FROM (SELECT unnest(['roc_auc_mean', 'fit_seconds_mean', 'fit_peak_mb_mean',
  'latency_ms_per_1k_mean', 'rmse_mean']) AS name FROM orders) WHERE NOT regexp_matches(name, 'seconds|peak_mb|latency') GROUP BY 1""")
def quality_metric_filter(spark, sf_dir):
    names = ["roc_auc_mean", "fit_seconds_mean", "fit_peak_mb_mean", "latency_ms_per_1k_mean", "rmse_mean"]
    rows = table(spark, sf_dir, "orders").select(F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    return report.quality_metrics(rows).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("study_seed_means", f"""WITH {_STORE} SELECT dataset, model, mode, round(avg("primary"), 6) AS "primary",
  round(coalesce(stddev_samp("primary"), 0), 6) AS primary_seed_std, round(avg(hpo_seconds_total), 6) AS hpo_cost, min(task) AS task
  FROM runs GROUP BY 1, 2, 3""")
def study_seed_means(spark, sf_dir):
    return report.seed_means(study_runs(spark, sf_dir)).withColumns(
        {c: F.round(c, 6) for c in ("primary", "primary_seed_std", "hpo_cost")})


_BOARD = f"""WITH {_STORE}, m AS (SELECT dataset, task, model, mode, avg("primary") AS p, coalesce(stddev_samp("primary"), 0) AS s,
  avg(hpo_seconds_total) AS c FROM runs GROUP BY ALL)"""


@query("study_leaderboard", _BOARD + """SELECT dataset, task, model, mode, round(p, 6) AS "primary", round(s, 6) AS primary_seed_std,
  round(c, 6) AS hpo_cost, p = max(p) OVER (PARTITION BY dataset) AS best FROM m""")
def study_leaderboard(spark, sf_dir):
    return report.leaderboard(study_runs(spark, sf_dir)).withColumns(
        {c: F.round(c, 6) for c in ("primary", "primary_seed_std", "hpo_cost")})


@query("study_leaderboard_text", _BOARD + f"""SELECT dataset, model, {_MODE_LABEL} AS mode,
  CASE WHEN p = max(p) OVER (PARTITION BY dataset) THEN '**' || printf('%.4f (%.4f)', p, s) || '**' ELSE printf('%.4f (%.4f)', p, s) END AS cell,
  coalesce(printf('%.1f', c), '-') AS cost FROM m""")
def study_leaderboard_text(spark, sf_dir):
    return report.leaderboard_text(report.leaderboard(study_runs(spark, sf_dir)))


_PIVOT = f"""{_BOARD}, pv AS (SELECT dataset, model, max(p) FILTER (mode = 'automated') AS automated,
  max(p) FILTER (mode = 'baseline_default') AS baseline_default, max(p) FILTER (mode = 'baseline_expert') AS baseline_expert FROM m GROUP BY 1, 2)"""


@query("study_mode_pivot", _PIVOT + """SELECT dataset, model, round(automated, 6) AS automated, round(baseline_default, 6) AS baseline_default,
  round(baseline_expert, 6) AS baseline_expert FROM pv""")
def study_mode_pivot(spark, sf_dir):
    return report.mode_pivot(study_runs(spark, sf_dir)).withColumns({m: F.round(m, 6) for m in config.MODES})


@query("study_complete_blocks", _PIVOT + """SELECT dataset, model, round(automated, 6) AS automated, round(baseline_default, 6) AS baseline_default,
  round(baseline_expert, 6) AS baseline_expert FROM pv WHERE automated IS NOT NULL AND baseline_default IS NOT NULL
  AND baseline_expert IS NOT NULL AND model <> 'linear'""")
def study_complete_blocks(spark, sf_dir):
    runs = study_runs(spark, sf_dir).filter((F.col("model") != "linear") | (F.col("mode") != "automated"))
    return report.complete_blocks(report.mode_pivot(runs)).withColumns({m: F.round(m, 6) for m in config.MODES})


_LONG_PAIRS = _PIVOT + """, pr AS (SELECT 'baseline_default' AS comparison, automated AS a, baseline_default AS b FROM pv
  UNION ALL SELECT 'baseline_expert', automated, baseline_expert FROM pv)"""


@query("study_comparisons", _LONG_PAIRS + """, r AS (SELECT comparison, d, rank() OVER (PARTITION BY comparison ORDER BY abs(d))
    + (count(*) OVER (PARTITION BY comparison, abs(d)) - 1) / 2e0 AS rk FROM (SELECT comparison, a - b AS d FROM pr) WHERE abs(d) > 1e-8),
  e AS (SELECT comparison, 2 * coalesce(sum(rk) FILTER (d > 0), 0) / sum(rk) - 1 AS effect FROM r GROUP BY 1)
  SELECT comparison, count(*) AS blocks, count(*) FILTER (a - b > 1e-9) AS win, count(*) FILTER (abs(a - b) <= 1e-9) AS tie,
  count(*) FILTER (a - b < -1e-9) AS loss, round(quantile_cont(a - b, 0.5), 6) AS median_delta, round(max(effect), 6) AS effect_size
  FROM pr JOIN e USING (comparison) GROUP BY 1""")
def study_comparisons(spark, sf_dir):
    rows = report.comparison_rows(study_runs(spark, sf_dir))
    return rows.select("comparison", "blocks", "win", "tie", "loss", F.round("median_delta", 6).alias("median_delta"),
                       F.round("effect_size", 6).alias("effect_size"))


@query("study_comparison_p_values")
def study_comparison_p(spark, sf_dir):
    return report.comparison_rows(study_runs(spark, sf_dir)).select("comparison", "p_value", "significant", "note")


_MODE_RANKS = _PIVOT + """, l AS (SELECT dataset, model, unnest(['automated', 'baseline_default', 'baseline_expert']) AS mode,
    unnest([automated, baseline_default, baseline_expert]) AS p FROM pv),
  k AS (SELECT dataset, model, mode, p, rank() OVER (PARTITION BY dataset, model ORDER BY p DESC)
    + (count(*) OVER (PARTITION BY dataset, model, p) - 1) / 2e0 AS rank FROM l)"""


@query("study_ranking", _MODE_RANKS + "SELECT mode, round(avg(rank), 6) AS average_rank FROM k GROUP BY 1")
def study_ranking(spark, sf_dir):
    return report.ranking_table(study_runs(spark, sf_dir)).withColumn("average_rank", F.round("average_rank", 6))


@query("study_ranking_test", _MODE_RANKS + """, s AS (SELECT mode, sum(rank) AS rs, count(*) AS n FROM k GROUP BY 1),
  t AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*) AS t FROM k GROUP BY dataset, model, p)),
  c AS (SELECT max(n) AS n, (12 * sum(rs * rs) / (max(n) * 12e0) - 12e0 * max(n)) / (1 - max(ties) / (max(n) * 24e0)) AS chi2 FROM s, t)
  SELECT n AS blocks, round(chi2, 6) AS chi2, round(exp(-chi2 / 2), 6) AS p_value FROM c""")
def study_ranking_test(spark, sf_dir):
    out = report.ranking_test(study_runs(spark, sf_dir))
    return out.select("blocks", F.round("chi2", 6).alias("chi2"), F.round("p_value", 6).alias("p_value"))


@query("study_calibration", f"""WITH {_STORE} SELECT mode, round(avg(ece_mean), 6) AS ece, round(avg(brier_mean), 6) AS brier FROM runs
  WHERE task = 'classification' GROUP BY 1""")
def study_calibration(spark, sf_dir):
    return report.calibration_classification(study_runs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("ece", "brier")})


@query("study_intervals", f"""WITH {_STORE} SELECT mode, round(avg(picp_80_mean), 6) AS picp, round(avg(mpiw_80_norm_mean), 6) AS mpiw FROM runs
  WHERE task = 'regression' AND picp_80_mean IS NOT NULL GROUP BY 1""")
def study_intervals(spark, sf_dir):
    return report.calibration_regression(study_runs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("picp", "mpiw")})


@query("study_efficiency", f"""WITH {_STORE} SELECT mode, round(median(coalesce(hpo_seconds_total, 0) + coalesce(fit_seconds_mean, 0)), 6) AS median_compute_s,
  round(median(model_size_mb_mean), 6) AS median_size_mb, round(median(latency_ms_per_1k_mean), 6) AS median_latency_ms FROM runs GROUP BY 1""")
def study_efficiency(spark, sf_dir):
    return report.efficiency(study_runs(spark, sf_dir)).withColumns(
        {c: F.round(c, 6) for c in ("median_compute_s", "median_size_mb", "median_latency_ms")})


@query("study_score_vs_compute", f"""WITH {_STORE}, s AS (SELECT dataset, min("primary") AS lo, max("primary") AS hi FROM runs GROUP BY 1)
  SELECT run_id, dataset, mode, round(greatest(coalesce(hpo_seconds_total, 0) + coalesce(fit_seconds_mean, 0), 0.01), 6) AS compute_s,
  round(("primary" - lo) / coalesce(nullif(hi - lo, 0), 1), 6) AS score_norm FROM runs JOIN s USING (dataset)""")
def study_score_vs_compute(spark, sf_dir):
    return report.score_compute_points(study_runs(spark, sf_dir)).withColumns(
        {c: F.round(c, 6) for c in ("compute_s", "score_norm")})


@query("study_seed_variance", f"""WITH {_STORE}, s AS (SELECT dataset || ' / ' || model || ' / ' || mode AS combination, stddev_samp("primary") AS sd
  FROM runs GROUP BY 1) SELECT (SELECT count(DISTINCT seed) FROM runs) AS n_seeds, round(median(sd), 6) AS median_seed_std,
  round(max(sd), 6) AS worst_seed_std, arg_max(combination, sd) AS worst FROM s WHERE sd IS NOT NULL""")
def study_seed_variance(spark, sf_dir):
    return report.seed_variance(study_runs(spark, sf_dir)).withColumns(
        {c: F.round(c, 6) for c in ("median_seed_std", "worst_seed_std")})


_BEST = """bp AS (SELECT run_id, ['standard', 'robust', 'quantile', 'none'][cast(floor(mpos * 4) AS INTEGER) + 1] AS scaler,
  CASE WHEN mpos < 0.7 THEN ['none', 'filter', 'l1'][cast(floor(mpos * 4) AS INTEGER) + 1] END AS selection
  FROM (SELECT run_id, cast(('0x' || substr(md5(run_id), 1, 7)) AS BIGINT) / 268435456e0 AS mpos FROM runs))"""


@query("study_decisions", f"""WITH {_STORE}, {_BEST}, c AS (SELECT dataset, tier, scaler, coalesce(selection, '-') AS selection
    FROM runs JOIN bp USING (run_id) WHERE mode = 'automated'),
  s AS (SELECT dataset, tier, scaler, row_number() OVER (PARTITION BY dataset, tier ORDER BY count(*) DESC, scaler) AS rn FROM c GROUP BY 1, 2, 3),
  t AS (SELECT dataset, tier, selection, row_number() OVER (PARTITION BY dataset, tier ORDER BY count(*) DESC, selection) AS rn FROM c GROUP BY 1, 2, 3)
  SELECT s.dataset, s.tier, scaler AS top_scaler, selection AS top_selection FROM s JOIN t ON s.dataset = t.dataset AND s.tier = t.tier WHERE s.rn = 1 AND t.rn = 1""")
def study_decisions(spark, sf_dir):
    runs = study_runs(spark, sf_dir)
    u = scalar.hash_unit(F.col("run_id"))
    scaler = F.get(F.array(*[F.lit(x) for x in ("standard", "robust", "quantile", "none")]), F.floor(u * 4).cast("int"))
    selection = F.get(F.array(*[F.lit(x) for x in ("none", "filter", "l1")]), F.floor(u * 4).cast("int"))
    params = F.when(u < 0.7, F.create_map(F.lit("prep.scaler"), scaler, F.lit("select.strategy"), selection)).otherwise(
        F.create_map(F.lit("prep.scaler"), scaler))
    as_json = runs.select("run_id", F.to_json(params).alias("j"))
    best = as_json.select("run_id", F.lit(0).alias("fold"), F.from_json("j", "map<string,string>").alias("params"))
    return report.decisions_vs_traits(runs, best)


@query("study_header", f"""WITH {_STORE} SELECT count(DISTINCT run_id) AS runs, count(DISTINCT dataset) AS datasets, list_sort(list(DISTINCT seed)) AS seeds FROM runs""")
def study_header(spark, sf_dir):
    return report.header(study_runs(spark, sf_dir))


@query("best_automated_run", f"""WITH {_STORE} SELECT run_id, model, round("primary", 6) AS "primary" FROM runs WHERE mode = 'automated' AND dataset = 'ds_AF'
  ORDER BY runs."primary" DESC, run_id LIMIT 1""")
def best_automated_run(spark, sf_dir):
    from foldwright.sources.modelstore import best_run

    best = best_run(study_runs(spark, sf_dir), "ds_AF")
    return best.select("run_id", "model", F.round("primary", 6).alias("primary"))


@query("audit_metric_pairing", f"""WITH {_STORE}, a AS (SELECT model AS name, avg("primary") AS v FROM runs WHERE seed = 42 GROUP BY 1),
  b AS (SELECT model AS name, avg("primary") AS v FROM runs WHERE seed = 43 GROUP BY 1)
  SELECT count(*) AS n_metrics, round(max(abs(a.v - b.v)), 6) AS max_delta FROM a JOIN b USING (name)""")
def audit_metric_pairing(spark, sf_dir):
    from foldwright.plans.audit import largest_delta

    runs = study_runs(spark, sf_dir)
    side = lambda s: runs.filter(F.col("seed") == s).groupBy(F.col("model").alias("name")).agg(F.avg("primary").alias("value"))
    out = largest_delta(side(42), side(43))
    return out.select("n_metrics", F.round("max_delta", 6).alias("max_delta"))


@query("param_map_namespace", """SELECT l_linenumber AS line, 'model' AS kept, cast(max(l_quantity) AS VARCHAR) AS alpha, cast(1 AS INTEGER) AS n_known FROM lineitem GROUP BY 1""")
def param_map_namespace(spark, sf_dir):
    params = F.create_map(F.lit("model.alpha"), F.max("l_quantity").cast("string"), F.lit("prep.scaler"), F.lit("none"),
                          F.lit("model.foreign"), F.lit("1"))
    maps = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("line")).agg(params.alias("p"))
    own = scalar.namespace(F.col("p"), "model")
    return maps.select("line", F.lit("model").alias("kept"), scalar.lookup(own, "alpha").alias("alpha"),
                       F.size(scalar.known_params(own, ["alpha", "max_iter"])).alias("n_known"))


@query("text_functions_documents", """SELECT doc_id, substr(text, 1, 500) AS cut, regexp_replace(source, '^www[.]', '') AS source,
  lang || '__' || doc_id || '__seed42' AS run_name, sha256(text) AS digest FROM documents""")
def text_functions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", scalar.truncated(F.col("text")).alias("cut"), F.regexp_replace("source", "^www[.]", "").alias("source"),
        F.concat_ws("__", "lang", F.col("doc_id").cast("string"), F.lit("seed42")).alias("run_name"), F.sha2("text", 256).alias("digest"))


@query("metric_names_common", f"""WITH {_STORE} SELECT DISTINCT model FROM runs WHERE task = 'classification' INTERSECT SELECT model FROM runs WHERE task = 'regression'""")
def metric_names_common(spark, sf_dir):
    runs = study_runs(spark, sf_dir)
    return runs.filter("task = 'classification'").select("model").intersect(runs.filter("task = 'regression'").select("model"))


