"""Queries over prediction tables: quality, calibration, intervals, aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.catalog.base import query
from foldwright.catalog.fixtures import with_cte
from foldwright.functions import scalar
from foldwright.operators import metrics
from foldwright.sources.datasets import predictions, table

KEYS = ["run", "fold"]


def _r(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("metric_accuracy_balanced_f1", with_cte("preds", extra="""
  cls AS (SELECT run, fold, c, count(*) FILTER (y = c) AS actual, count(*) FILTER (pred = c) AS guessed,
    count(*) FILTER (y = c AND pred = c) AS hit FROM preds, (SELECT unnest([0, 1]) AS c) GROUP BY ALL)""")
  + """SELECT run, fold, round(sum(hit) / sum(actual)::DOUBLE, 6) AS accuracy,
  round(avg(CASE WHEN actual > 0 THEN hit / actual::DOUBLE END), 6) AS balanced_accuracy,
  round(avg(2e0 * hit / (actual + guessed)), 6) AS f1_macro FROM cls
  WHERE actual + guessed > 0 GROUP BY run, fold""")
def metric_accuracy(spark, sf_dir):
    out = metrics.class_metrics(predictions(spark, sf_dir), KEYS)
    return _r(out, "accuracy", "balanced_accuracy", "f1_macro")


_AUC = """SELECT run, fold, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1)
    + 1) / 2e0) / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)) AS roc_auc
  FROM (SELECT run, fold, y, rank() OVER (PARTITION BY run, fold ORDER BY p1)
    + (count(*) OVER (PARTITION BY run, fold, p1) - 1) / 2e0 AS r FROM preds) GROUP BY run, fold"""


@query("metric_roc_auc_binary", with_cte("preds")
       + f"SELECT run, fold, round(roc_auc, 6) AS roc_auc FROM ({_AUC})")
def metric_roc_auc(spark, sf_dir):
    return _r(metrics.roc_auc(predictions(spark, sf_dir), KEYS), "roc_auc")


def order_predictions(spark, sf_dir):
    """Three-class predictions over orders with many distinct scores."""
    o = table(spark, sf_dir, "orders")
    a = F.floor(F.col("o_totalprice")).cast("long") % 1000
    b = F.col("o_custkey") % 1000
    label = F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus")) - 1
    scored = o.select(
        F.col("o_orderkey").cast("string").alias("row_id"),
        (F.col("o_orderkey") % 3).cast("int").alias("run"),
        label.cast("int").alias("y"),
        F.array(a / 2000, b / 2000, (2000 - a - b) / 2000).alias("proba"),
    )
    return scored.withColumn("pred", scalar.argmax(F.col("proba")))


_ORDERS3 = """o3 AS (SELECT cast(o_orderkey AS VARCHAR) AS row_id, cast(o_orderkey % 3 AS INTEGER) AS run,
   CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y, a / 2000e0 AS p0, b / 2000e0 AS p1,
   (2000 - a - b) / 2000e0 AS p2 FROM (SELECT *, cast(floor(o_totalprice) AS BIGINT) % 1000 AS a,
   o_custkey % 1000 AS b FROM orders)),
  o3p AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred,
   greatest(p0, p1, p2) AS conf, [p0, p1, p2] AS p FROM o3)"""


@query("metric_roc_auc_one_vs_rest", f"""WITH {_ORDERS3}, s AS (SELECT run, c, (y = c)::INT AS pos,
    p[c + 1] AS score FROM o3p, (SELECT unnest([0, 1, 2]) AS c)),
  r AS (SELECT run, c, pos, rank() OVER (PARTITION BY run, c ORDER BY score)
    + (count(*) OVER (PARTITION BY run, c, score) - 1) / 2e0 AS r FROM s),
  a AS (SELECT run, c, (sum(r) FILTER (pos = 1) - sum(pos) * (sum(pos) + 1) / 2e0)
    / (sum(pos)::DOUBLE * (count(*) - sum(pos))) AS auc FROM r GROUP BY run, c)
  SELECT run, round(avg(auc), 6) AS roc_auc FROM a GROUP BY run""")
def metric_roc_auc_ovr(spark, sf_dir):
    return _r(metrics.roc_auc(order_predictions(spark, sf_dir), ["run"]), "roc_auc")


@query("metric_log_loss", with_cte("preds") + """SELECT run, fold, round(avg(-ln(greatest(least(
  CASE WHEN y = 1 THEN p1 ELSE p0 END, 1 - 2.220446049250313e-16), 2.220446049250313e-16))), 6) AS log_loss
  FROM preds GROUP BY run, fold""")
def metric_log_loss(spark, sf_dir):
    return _r(metrics.log_loss(predictions(spark, sf_dir), KEYS), "log_loss")


def regression_predictions(spark, sf_dir):
    """A hand-made price model over lineitem, with an interval."""
    li = table(spark, sf_dir, "lineitem")
    pred = F.col("l_extendedprice") * 0.95
    return li.select(
        F.col("l_returnflag").alias("run"),
        (F.col("l_linenumber") % 5).alias("fold"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("y"),
        pred.alias("pred"),
        (pred * 0.96).alias("a"),
        (pred * (1.06 - F.col("l_discount"))).alias("b"),
    )


_REG = """reg AS (SELECT l_returnflag AS run, l_linenumber % 5 AS fold,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS y, l_extendedprice * 0.95e0 AS pred,
  l_extendedprice * 0.95e0 * 0.96e0 AS a, l_extendedprice * 0.95e0 * (1.06e0 - l_discount) AS b FROM lineitem)"""


@query("metric_regression", f"""WITH {_REG} SELECT run, fold, round(sqrt(avg((y - pred) ** 2)), 4) AS rmse,
  round(-sqrt(avg((y - pred) ** 2)), 4) AS neg_rmse, round(avg(abs(y - pred)), 4) AS mae,
  round(1 - avg((y - pred) ** 2) / var_pop(y), 6) AS r2 FROM reg GROUP BY run, fold""")
def metric_regression(spark, sf_dir):
    out = metrics.regression_metrics(regression_predictions(spark, sf_dir), KEYS)
    return _r(_r(out, "rmse", "neg_rmse", "mae", digits=4), "r2")


_ECE3 = """SELECT run, sum(abs(hits - conf)) / sum(n) AS ece FROM (SELECT run, bin, count(*) AS n,
  sum((pred = y)::INT) AS hits, sum(conf) AS conf FROM (SELECT run, y, pred, conf,
  (SELECT min(i) FROM range(1, 16) t(i) WHERE conf <= i / 15e0) AS bin FROM o3p) GROUP BY run, bin)
  GROUP BY run"""


@query("calibration_ece", f"WITH {_ORDERS3} SELECT run, round(ece, 6) AS ece FROM ({_ECE3})")
def calibration_ece(spark, sf_dir):
    return _r(metrics.expected_calibration_error(order_predictions(spark, sf_dir), ["run"]), "ece")


@query("calibration_ece_binary", with_cte("preds", extra="""c AS (SELECT run, fold, y, pred,
    greatest(p0, p1) AS conf FROM preds)""") + """SELECT run, fold, round(sum(abs(hits - conf)) / sum(n), 6) AS ece
  FROM (SELECT run, fold, bin, count(*) AS n, sum((pred = y)::INT) AS hits, sum(conf) AS conf FROM (
    SELECT *, (SELECT min(i) FROM range(1, 16) t(i) WHERE conf <= i / 15e0) AS bin FROM c)
    GROUP BY run, fold, bin) GROUP BY run, fold""")
def calibration_ece_binary(spark, sf_dir):
    return _r(metrics.expected_calibration_error(predictions(spark, sf_dir), KEYS), "ece")


@query("calibration_brier", f"""WITH {_ORDERS3} SELECT run, round(avg((p0 - (y = 0)::INT) ** 2
  + (p1 - (y = 1)::INT) ** 2 + (p2 - (y = 2)::INT) ** 2), 6) AS brier FROM o3p GROUP BY run""")
def calibration_brier(spark, sf_dir):
    return _r(metrics.brier_score(order_predictions(spark, sf_dir), ["run"]), "brier")


@query("interval_coverage_width", f"""WITH {_REG} SELECT run, fold,
  round(avg((y BETWEEN least(a, b) AND greatest(a, b))::INT), 6) AS picp_80,
  round(avg(greatest(a, b) - least(a, b)) / stddev_pop(y), 6) AS mpiw_80_norm FROM reg GROUP BY run, fold""")
def interval_coverage(spark, sf_dir):
    bounded = metrics.sorted_bounds(regression_predictions(spark, sf_dir), "a", "b")
    return _r(metrics.interval_metrics(bounded, KEYS), "picp_80", "mpiw_80_norm")


@query("interval_gaussian_events", f"""WITH s AS (SELECT event_type, avg(value) AS mean, stddev_pop(value)
    AS std FROM events GROUP BY 1), z AS (SELECT {scalar.normal_ppf_sql('0.9e0')} AS z)
  SELECT event_type, round(avg((value BETWEEN mean - z * std AND mean + z * std)::INT), 6) AS picp_80,
  round(2 * max(z), 6) AS mpiw_80_norm FROM events JOIN s USING (event_type), z GROUP BY 1""")
def interval_gaussian(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("y"))
    s = ev.groupBy("event_type").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"))
    # Five event types: the per-type row is tiny by nature of the column.
    bounds = metrics.gaussian_interval(s)
    joined = ev.join(F.broadcast(bounds), "event_type")
    return _r(metrics.interval_metrics(joined, ["event_type"]), "picp_80", "mpiw_80_norm")


_PANEL = f"""acc AS (SELECT run, fold, avg((y = pred)::INT) AS v FROM preds GROUP BY ALL),
  auc AS ({_AUC}),
  brier AS (SELECT run, fold, avg((p0 - (y = 0)::INT) ** 2 + (p1 - (y = 1)::INT) ** 2) AS v FROM preds GROUP BY ALL),
  ll AS (SELECT run, fold, avg(-ln(greatest(least(CASE WHEN y = 1 THEN p1 ELSE p0 END,
    1 - 2.220446049250313e-16), 2.220446049250313e-16))) AS v FROM preds GROUP BY ALL),
  long AS (SELECT run, fold, 'accuracy' AS name, v FROM acc UNION ALL SELECT run, fold, 'roc_auc', roc_auc FROM auc
    UNION ALL SELECT run, fold, 'brier', v FROM brier UNION ALL SELECT run, fold, 'log_loss', v FROM ll)"""


@query("metric_panel_per_fold", with_cte("preds", extra=_PANEL)
       + "SELECT run, fold, name, round(v, 6) AS value FROM long")
def metric_panel(spark, sf_dir):
    rows = metrics.panel(predictions(spark, sf_dir), KEYS, "classification")
    keep = rows.filter(F.col("name").isin("accuracy", "roc_auc", "brier", "log_loss"))
    return _r(keep, "value")


@query("primary_score_per_fold", with_cte("preds")
       + f"SELECT run, fold, round(roc_auc, 6) AS \"primary\" FROM ({_AUC})")
def primary_score(spark, sf_dir):
    rows = metrics.panel(predictions(spark, sf_dir), KEYS, "classification")
    return _r(metrics.primary_score(rows, KEYS, "classification"), "primary")


@query("fold_aggregate_metrics", f"""WITH {_REG}, f AS (SELECT run, fold, sqrt(avg((y - pred) ** 2)) AS rmse,
    avg(abs(y - pred)) AS mae FROM reg GROUP BY run, fold),
  l AS (SELECT run, 'rmse' AS name, rmse AS v FROM f UNION ALL SELECT run, 'mae', mae FROM f)
  SELECT run, name || '_mean' AS metric, round(avg(v), 4) AS value FROM l GROUP BY run, name
  UNION ALL SELECT run, name || '_std', round(stddev_pop(v), 4) FROM l GROUP BY run, name""")
def fold_aggregate(spark, sf_dir):
    rows = metrics.panel(regression_predictions(spark, sf_dir), KEYS, "regression")
    keep = rows.filter(F.col("name").isin("rmse", "mae"))
    return _r(metrics.fold_aggregate(keep, ["run"]), "value", digits=4)


@query("running_mean_inner_folds", """WITH s AS (SELECT l_suppkey AS trial, l_linenumber AS step,
    sum(cast(l_quantity AS BIGINT)) / count(*)::DOUBLE AS value FROM lineitem GROUP BY ALL)
  SELECT trial, step, round(avg(value) OVER (PARTITION BY trial ORDER BY step ROWS UNBOUNDED PRECEDING), 6)
    AS reported FROM s""")
def running_mean(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("trial"), F.col("l_linenumber").alias("step")
    ).agg((F.sum(F.col("l_quantity").cast("long")) / F.count(F.lit(1))).alias("value"))
    return _r(metrics.running_mean(s, ["trial"]).drop("value"), "reported")


@query("normal_ppf_values", f"""SELECT l_linenumber, round(sum({scalar.normal_ppf_sql('p')}), 4) AS z FROM (
  SELECT l_linenumber, (l_quantity - 0.5e0) / 50e0 AS p FROM lineitem) GROUP BY 1""")
def normal_ppf_values(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_linenumber", ((F.col("l_quantity") - 0.5) / 50).alias("p"))
    return li.groupBy("l_linenumber").agg(F.round(F.sum(scalar.normal_ppf("p")), 4).alias("z"))


@query("probability_argmax", f"WITH {_ORDERS3} SELECT row_id, pred, conf FROM o3p")
def probability_argmax(spark, sf_dir):
    return order_predictions(spark, sf_dir).select(
        "row_id", "pred", F.array_max("proba").alias("conf"))
