"""Queries over model families, feature selection, experiments and studies."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.catalog.base import query
from foldwright.catalog.fixtures import with_cte
from foldwright.models import linear, neighbours, trees
from foldwright.models.mlp import MLP, MLPState, Shape
from foldwright.models.sgd import SGD, SGDState, contribution
from foldwright.models.synchronous import lay_out, summed_step
from foldwright.models.zoo import build_model, build_quantile_model
from foldwright.operators import metrics, preprocess, selection, splits
from foldwright.operators.columns import TARGET, encode_target
from foldwright.plans import audit, experiment, objective, scaling, search
from foldwright.sources.config import search_space
from foldwright.sources.datasets import Dataset, dataset, table

_FOLDED = """f AS (SELECT *, cast((row_number() OVER (ORDER BY md5('42:' || row_id), row_id) - 1) % 5 AS INTEGER) AS fold FROM line_reg),
  k AS (SELECT unnest([0, 1, 2, 3, 4]) AS s), tr AS (SELECT s, f.* FROM f, k WHERE fold <> s),
  p AS (SELECT s, avg(l_extendedprice) AS c, stddev_pop(l_extendedprice) AS sd FROM tr GROUP BY s),
  z AS (SELECT tr.s, (l_extendedprice - c) / sd AS x, __target__ AS y FROM tr JOIN p USING (s)),
  m AS (SELECT s, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy FROM z GROUP BY s),
  w AS (SELECT s, sxy / (sxx + {alpha}) AS b, my - mx * sxy / (sxx + {alpha}) AS a FROM m),
  e AS (SELECT f.fold, __target__ AS y, a + b * (l_extendedprice - c) / sd AS pred FROM f JOIN p ON p.s = f.fold JOIN w ON w.s = f.fold)"""


def _folded_price(spark, sf_dir):
    """Folded line items with the price standardised by the training rows of the row's own fold."""
    df = dataset(spark, sf_dir, "line_reg").df.select("row_id", "l_extendedprice", TARGET)
    return splits.kfold(df, 42, "regression")


@query("ridge_cross_validation", with_cte("line_reg", extra=_FOLDED.format(alpha="1e0")) + """SELECT fold, round(sqrt(avg((y - pred) ** 2)), 4) AS rmse,
  round(avg(abs(y - pred)), 4) AS mae, round(1 - avg((y - pred) ** 2) / var_pop(y), 6) AS r2 FROM e GROUP BY fold""")
def ridge_cross_validation(spark, sf_dir):
    """Folds, per-fold scaling, ridge per fold from one Gram pass, scores per fold.

    Raw Gram blocks are summed once per fold; scaling a training set is then
    algebra on its (d+2)^2 numbers, so no row is copied per fold.
    """
    folded = _folded_price(spark, sf_dir).persist()
    rows = folded.select("row_id", "fold", TARGET, F.array("l_extendedprice").alias("features"))
    grams = linear.gram_by_fold(rows)
    coefficients = {}
    for fold in grams:
        g = linear.training_gram(grams, fold)
        n, mean = g[0, 0], g[0, 1] / g[0, 0]
        sd = max((g[1, 1] / n - mean * mean), 0.0) ** 0.5 or 1.0
        scaled = linear.rescaled_gram(g, [mean], [sd])
        coefficients[fold] = linear.raw_coefficients(linear.ridge_solution(scaled, 1.0), [mean], [sd])
    preds = linear.fold_predictions(rows, coefficients).withColumnRenamed(TARGET, "y")
    out = metrics.regression_metrics(preds, ["fold"])
    return out.select("fold", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


_ALPHAS = (0.001, 1.0, 100.0, 10000.0)


@query("ridge_alpha_grid", with_cte("line_reg", extra=_FOLDED.split(",\n  w AS")[0].format(alpha="")) + """SELECT cast(s AS INTEGER) AS fold, alpha,
  round(sxy / (sxx + alpha), 3) AS slope, round(my - mx * sxy / (sxx + alpha), 3) AS intercept FROM m, (SELECT unnest([0.001e0, 1e0, 100e0, 10000e0]) AS alpha)""")
def ridge_alpha_grid(spark, sf_dir):
    """Every penalty on every training set from one pass over the rows."""
    rows = _folded_price(spark, sf_dir).select("row_id", "fold", TARGET, F.array("l_extendedprice").alias("features"))
    grams = linear.gram_by_fold(rows)
    out = []
    for fold in grams:
        g = linear.training_gram(grams, fold)
        mean = g[0, 1] / g[0, 0]
        sd = max(g[1, 1] / g[0, 0] - mean * mean, 0.0) ** 0.5
        scaled = linear.rescaled_gram(g, [mean], [sd])
        for alpha in _ALPHAS:
            w = linear.ridge_solution(scaled, alpha)
            out.append((int(fold), alpha, round(float(w[1]), 3) + 0.0, round(float(w[0]), 3) + 0.0))
    return spark.createDataFrame(out, "fold int, alpha double, slope double, intercept double")


@query("ridge_two_features", """WITH c AS (SELECT count(*) AS n, avg(l_extendedprice) AS m1, avg(l_quantity) AS m2, avg(y) AS my,
    var_pop(l_extendedprice) * count(*) + 1 AS a, covar_pop(l_extendedprice, l_quantity) * count(*) AS b, var_pop(l_quantity) * count(*) + 1 AS d,
    covar_pop(l_extendedprice, y) * count(*) AS u, covar_pop(l_quantity, y) * count(*) AS v
    FROM (SELECT *, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS y FROM lineitem))
  SELECT round((d * u - b * v) / (a * d - b * b), 6) AS w_price, round((a * v - b * u) / (a * d - b * b), 4) AS w_quantity,
  round(my - m1 * (d * u - b * v) / (a * d - b * b) - m2 * (a * v - b * u) / (a * d - b * b), 2) AS intercept FROM c""")
def ridge_two_features(spark, sf_dir):
    df = dataset(spark, sf_dir, "line_reg").df
    rows = df.select("row_id", TARGET, F.array("l_extendedprice", "l_quantity").alias("features"))
    w = linear.Ridge(1.0).fit(rows).coefficients
    return spark.createDataFrame([(float(round(w[1], 6)), float(round(w[2], 4)), float(round(w[0], 2)))],
                                 "w_price double, w_quantity double, intercept double")


@query("lasso_one_feature", """WITH c AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS q, covar_pop(x, y) AS r FROM (SELECT l_extendedprice / 1000 AS x,
    l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1000 AS y FROM lineitem))
  SELECT round(sign(r) * greatest(abs(r) - 5e0, 0) / q, 6) AS slope, round(my - mx * sign(r) * greatest(abs(r) - 5e0, 0) / q, 5) AS intercept FROM c""")
def lasso_one_feature(spark, sf_dir):
    df = dataset(spark, sf_dir, "line_reg").df
    rows = df.select("row_id", (F.col(TARGET) / 1000).alias(TARGET), F.array(F.col("l_extendedprice") / 1000).alias("features"))
    w = linear.Lasso(5.0).fit(rows).coefficients
    return spark.createDataFrame([(float(round(w[1], 6)), float(round(w[0], 5)))], "slope double, intercept double")


# ---------------------------------------------------------------- nearest neighbours

_EMB = """e AS (SELECT cast(vec_id AS VARCHAR) AS row_id, embedding::DOUBLE[] AS v, label,
    (row_number() OVER (ORDER BY md5('42:' || vec_id), cast(vec_id AS VARCHAR)) - 1) % 5 AS fold FROM embeddings),
  d AS (SELECT q.row_id AS query_id, t.row_id AS train_id, t.label AS y, list_distance(q.v, t.v) AS distance
    FROM e q JOIN e t ON q.fold = 0 AND t.fold <> 0),
  n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS rn FROM d)"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"),
        F.col("label").alias(TARGET))


def _embeddings(spark, sf_dir):
    """Training and test side of the first outer fold over all embeddings."""
    return splits.fold_sides(splits.kfold(_vectors(spark, sf_dir), 42, "regression"), 0)


@query("knn_neighbours", """WITH e AS (SELECT cast(vec_id AS VARCHAR) AS row_id, embedding::DOUBLE[] AS v FROM embeddings),
  n AS (SELECT q.row_id AS query_id, t.row_id AS train_id, list_distance(q.v, t.v) AS distance FROM e q, e t)
  SELECT query_id, train_id, rn, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY distance, train_id) AS rn FROM n) WHERE rn <= 10""")
def knn_neighbours(spark, sf_dir):
    """The ten nearest vectors of every vector, itself included."""
    vectors = _vectors(spark, sf_dir)
    out = neighbours.neighbour_table(vectors, vectors, 10, block_rows=500)
    return out.select("query_id", "train_id", F.col("rn").cast("long").alias("rn"), F.round("distance", 6).alias("distance"))


@query("knn_vote_grid", f"""WITH {_EMB}, g AS (SELECT unnest([3, 11]) AS k), u AS (SELECT k, query_id, y, count(*) AS w FROM n, g WHERE rn <= k GROUP BY ALL),
  x AS (SELECT k, query_id, y, sum(1 / distance) AS w FROM n, g WHERE rn <= k GROUP BY ALL),
  a AS (SELECT 'uniform' AS weights, k, query_id, arg_max(y, w * 1e6 - y) AS pred FROM u GROUP BY ALL
    UNION ALL SELECT 'distance', k, query_id, arg_max(y, w) FROM x GROUP BY ALL)
  SELECT weights, k, cast(pred AS INTEGER) AS pred, count(*) AS n FROM a GROUP BY ALL""")
def knn_vote_grid(spark, sf_dir):
    """All (k, weights) candidates from one neighbour table."""
    train, queries = _embeddings(spark, sf_dir)
    shared = neighbours.neighbour_table(train, queries, 11, block_rows=500).persist()
    parts = [
        neighbours.vote(shared, k, w, "classification", 10).select(F.lit(w).alias("weights"), F.lit(k).alias("k"), "pred")
        for k in (3, 11) for w in ("uniform", "distance")
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("weights", "k", "pred").agg(F.count(F.lit(1)).alias("n"))


@query("knn_regression", f"WITH {_EMB} SELECT query_id, round(sum(y / distance) / sum(1 / distance), 6) AS pred FROM n WHERE rn <= 5 GROUP BY 1")
def knn_regression(spark, sf_dir):
    train, queries = _embeddings(spark, sf_dir)
    near = neighbours.neighbour_table(train, queries, 5, block_rows=500)
    out = neighbours.vote(near, 5, "distance", "regression")
    return out.select("query_id", F.round("pred", 6).alias("pred"))


# ---------------------------------------------------------------- feature selection


def _line_features(spark, sf_dir):
    """line_cls with imputed, scaled and encoded features."""
    ds = dataset(spark, sf_dir, "line_cls")
    df = encode_target(ds.df, ds.task)
    return preprocess.Preprocessor(ds.numeric, ds.categorical, ds.task).fit(df).transform(df)


@query("select_passthrough", """SELECT event_id, value AS f0, value * 2 AS f1 FROM events""")
def select_passthrough(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.array("value", F.col("value") * 2).alias("features"))
    kept = selection.select_features(rows, "none", "regression")
    out = rows if kept is None else selection.keep_positions(rows, kept)
    return out.select("event_id", F.get("features", F.lit(0)).alias("f0"), F.get("features", F.lit(1)).alias("f1"))


@query("select_variance", """SELECT 0 AS feature, round(var_pop(value), 4) AS variance FROM events UNION ALL SELECT 1, 0
  UNION ALL SELECT 2, round(var_pop(user_id % 10), 4) FROM events""")
def select_variance(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.array(F.col("value"), F.lit(1.5), (F.col("user_id") % 10).cast("double")).alias("features"))
    return selection.variances(rows).select("feature", F.round("variance", 4).alias("variance"))


_MI = """r AS (SELECT l_discount, l_quantity, l_extendedprice, (l_discount * 10 + l_quantity / 50
    + (CASE WHEN l_returnflag = 'R' THEN 0.5e0 ELSE 0e0 END) > 1.15e0)::INT AS y FROM lineitem),
  l AS (SELECT 0 AS feature, l_discount AS v, y FROM r UNION ALL SELECT 1, l_quantity, y FROM r UNION ALL SELECT 2, l_extendedprice, y FROM r),
  q AS (SELECT feature, list_distinct(quantile_cont(v, [""" + ", ".join(f"{i}/32.0" for i in range(1, 32)) + """])) AS e FROM l GROUP BY 1),
  b AS (SELECT feature, y, list_sum(list_transform(e, lambda x: (x < v)::INT)) AS b FROM l JOIN q USING (feature)),
  c AS (SELECT feature, b, y, count(*) AS n FROM b GROUP BY ALL),
  j AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny FROM c)"""


@query("select_mutual_information", f"WITH {_MI} SELECT feature, round(sum(n / t * ln(n * t / (nb * ny))), 6) AS mi FROM j GROUP BY 1")
def select_mutual_information(spark, sf_dir):
    df = encode_target(dataset(spark, sf_dir, "line_cls").df, "classification")
    rows = df.select(TARGET, F.array("l_discount", "l_quantity", "l_extendedprice").alias("features"))
    return selection.mutual_information(rows, "classification").select("feature", F.round("mi", 6).alias("mi"))


@query("select_top_percentile", f"""WITH {_MI}, s AS (SELECT feature, sum(n / t * ln(n * t / (nb * ny))) AS mi FROM j GROUP BY 1)
  SELECT feature FROM s WHERE mi >= (SELECT quantile_cont(mi, 0.5) FROM s)""")
def select_top_percentile(spark, sf_dir):
    df = encode_target(dataset(spark, sf_dir, "line_cls").df, "classification")
    rows = df.select(TARGET, F.array("l_discount", "l_quantity", "l_extendedprice").alias("features"))
    scores = selection.mutual_information(rows, "classification")
    return selection.top_percentile(scores, "mi", 50).select("feature")


def _kept(spark, kept):
    return spark.createDataFrame([(int(i),) for i in kept], "kept int")


@query("select_l1")
def select_l1(spark, sf_dir):
    return _kept(spark, selection.by_l1(_line_features(spark, sf_dir), "classification"))


@query("select_tree_importance")
def select_tree(spark, sf_dir):
    return _kept(spark, selection.by_tree(_line_features(spark, sf_dir), "classification", 2, 0, trees=10))


@query("select_recursive_elimination")
def select_rfe(spark, sf_dir):
    return _kept(spark, selection.by_elimination(_line_features(spark, sf_dir), "classification", 2, 0, 0.6, trees=6))


# ---------------------------------------------------------------- model families


def _score(spark, sf_dir, name, model, params, head=None):
    """Fit on the training side of fold 0 over the whole table, score the test side."""
    ds = dataset(spark, sf_dir, name)
    rows, names, _ = experiment.prepare_rows(ds)
    train, test = splits.fold_sides(splits.kfold(rows, 42, ds.task).persist(), 0)
    prep = preprocess.Preprocessor(ds.numeric, ds.categorical, ds.task, classes=len(names) or 2).fit(train.drop("fold"))
    # Not kept: every model keeps its own form of the rows while it reads them more than once.
    ready = prep.transform(train.drop("fold"), training=True)
    fitted = (head or build_model(model, ds.task, 7, params, len(names) or 2)).fit(ready)
    scored = fitted.predict(prep.transform(test))
    extra = ["proba"] if ds.task == "classification" else []
    preds = scored.select(F.col(TARGET).alias("y"), "pred", *extra, "fold")
    out = metrics.panel(preds, ["fold"], ds.task)
    return out.select(F.lit(name).alias("dataset"), F.lit(model).alias("model"), "name", "value")


_MODEL_QUERIES = (
    ("model_logistic", "line_cls", "linear", {}),
    ("model_ridge", "line_reg", "linear", {}),
    ("model_lasso", "line_reg", "lasso", {"alpha": 0.01}),
    ("model_sgd_classification", "line_cls", "sgd_linear", {}),
    ("model_sgd_regression", "line_reg", "sgd_linear", {"penalty": "elasticnet"}),
    ("model_random_forest", "line_cls", "random_forest", {"n_estimators": 20, "max_depth": 8}),
    ("model_random_forest_regression", "line_reg", "random_forest", {"n_estimators": 10, "max_depth": 8}),
    ("model_extra_trees", "line_cls", "extra_trees", {"n_estimators": 10, "max_depth": 6}),
    ("model_extra_trees_regression", "line_reg", "extra_trees", {"n_estimators": 6, "max_depth": 5}),
    ("model_hist_gb", "line_cls", "hist_gb", {"max_iter": 8, "max_depth": 4, "learning_rate": 0.3}),
    ("model_hist_gb_multiclass", "order_cls3", "hist_gb", {"max_iter": 4, "max_depth": 3}),
    ("model_xgboost_regression", "line_reg", "xgboost", {"n_estimators": 8, "max_depth": 4, "subsample": 0.8, "colsample_bytree": 0.8}),
    ("model_kernel_machine", "line_cls", "svm", {"C": 1.0}),
    ("model_kernel_machine_regression", "part_reg", "svm", {"C": 1.0}),
    ("model_knn", "doc_quality", "knn", {"weights": "distance"}),
    ("model_mlp", "line_cls", "torch_mlp", {"max_epochs": 5, "hidden_dim": 64, "lr": 0.005}),
    ("model_mlp_regression", "line_reg", "torch_mlp", {"max_epochs": 5, "hidden_dim": 64, "lr": 0.005}),
)


def _register_model(name, data, model, params):
    @query(name)
    def run(spark, sf_dir):
        return _score(spark, sf_dir, data, model, params)


for _q in _MODEL_QUERIES:
    _register_model(*_q)


@query("model_quantile_head")
def model_quantile_head(spark, sf_dir):
    """Coverage of the 10 % and 90 % boosters on held-out rows."""
    ds = dataset(spark, sf_dir, "line_reg")
    train, test = splits.fold_sides(splits.kfold(encode_target(ds.df, ds.task), 42, ds.task).persist(), 0)
    prep = preprocess.Preprocessor(ds.numeric, ds.categorical, ds.task).fit(train)
    ready, held = prep.transform(train, training=True).persist(), prep.transform(test)
    out = None
    for q, name in ((0.1, "a"), (0.9, "b")):
        fitted = build_quantile_model(q, 7, {"max_iter": 5, "max_depth": 3, "learning_rate": 0.4}).fit(ready)
        one = fitted.predict(held).select("row_id", F.col(TARGET).alias("y"), F.col("pred").alias(name))
        out = one if out is None else out.join(one.drop("y"), "row_id")
    bounded = metrics.sorted_bounds(out, "a", "b").withColumn("model", F.lit("hist_gb"))
    return metrics.interval_metrics(bounded, ["model"])


@query("model_dropout_uncertainty")
def model_dropout_uncertainty(spark, sf_dir):
    """Dropout intervals of the perceptron on parts: coverage, width, smallest spread."""
    ds = dataset(spark, sf_dir, "part_reg")
    rows = encode_target(ds.df, ds.task)
    prep = preprocess.Preprocessor(ds.numeric, ds.categorical, ds.task).fit(rows)
    # a file of many short rows has few partitions, so they are dealt before they become wide
    ready = prep.transform(rows.repartition("row_id")).persist()
    fitted = MLP("regression", hidden_dim=32, max_epochs=5, lr=0.01).fit(ready)
    bounds = metrics.gaussian_interval(fitted.predict_uncertainty(ready)).join(ready.select("row_id", F.col(TARGET).alias("y")), "row_id").persist()
    out = metrics.interval_metrics(bounds.withColumn("model", F.lit("torch_mlp")), ["model"])
    return out.withColumn("least_std", bounds.agg(F.min("std")).scalar())


def _step_rows(spark, sf_dir, target):
    """Lineitem with two features, dealt into one mini-batch."""
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    features = F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10)
    return lay_out(table(spark, sf_dir, "lineitem").select(key.alias("row_id"), features.alias("features"), target.alias(TARGET)), steps=1)


@query("sgd_one_step", """WITH r AS (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS y FROM lineitem),
  e AS (SELECT a, b, 1e0 / (1e0 + exp(-(0.1e0 - 0.2e0 * a + 0.3e0 * b))) - y AS e, ln(1e0 + exp(0.1e0 - 0.2e0 * a + 0.3e0 * b)) - y * (0.1e0 - 0.2e0 * a + 0.3e0 * b) AS loss FROM r),
  g AS (SELECT avg(e) AS g0, avg(e * a) AS g1, avg(e * b) AS g2, avg(loss) AS loss FROM e)
  SELECT round(0.1e0 - 0.3e0 * g0, 9) AS w0, round((-0.2e0 - 0.3e0 * g1) * (1 - 0.3e0 * 1e-4), 9) AS w1,
    round((0.3e0 - 0.3e0 * g2) * (1 - 0.3e0 * 1e-4), 9) AS w2, round(loss, 9) AS loss FROM g""")
def sgd_one_step(spark, sf_dir):
    """One synchronous step of the logistic SGD from given weights."""
    rows = _step_rows(spark, sf_dir, (F.col("l_returnflag") == "R").cast("double"))
    w = np.array([[0.1, -0.2, 0.3]])
    n, sums = summed_step(rows, 0, lambda x, y, block: contribution("classification", w, x, y))
    after = SGD("classification", eta0=0.3, alpha=1e-4).step(SGDState(w), n, sums).weights[0]
    out = [(*(round(float(v), 9) for v in after), round(float(sums[0] / n), 9))]
    return spark.createDataFrame(out, "w0 double, w1 double, w2 double, loss double")


@query("mlp_one_step", """WITH r AS (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 10 AS y FROM lineitem),
  z AS (SELECT *, 0.05e0 + 0.3e0 * a + 0.1e0 * b AS z0, -0.1037e0 - 0.2e0 * a + 0.4e0 * b AS z1 FROM r),
  d AS (SELECT *, 2 * (0.5e0 * greatest(z0, 0) - 0.3e0 * greatest(z1, 0) + 0.2e0 - y) AS d FROM z),
  k AS (SELECT *, CASE WHEN z0 > 0 THEN 0.5e0 * d ELSE 0e0 END AS d0, CASE WHEN z1 > 0 THEN -0.3e0 * d ELSE 0e0 END AS d1 FROM d),
  g AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS position, unnest([0.3e0, -0.2e0, 0.1e0, 0.4e0, 0.05e0, -0.1037e0, 0.5e0, -0.3e0, 0.2e0]) AS w,
    unnest([avg(a * d0), avg(a * d1), avg(b * d0), avg(b * d1), avg(d0), avg(d1), avg(d * greatest(z0, 0)), avg(d * greatest(z1, 0)), avg(d)]) AS gradient FROM k)
  SELECT position, round(gradient, 8) AS gradient, round(w - 0.01e0 * (gradient / (abs(gradient) + 1e-8) + 1e-4 * w), 8) AS weight FROM g""")
def mlp_one_step(spark, sf_dir):
    """The gradient of a small perceptron with given weights, and its weights after one AdamW step."""
    rows = _step_rows(spark, sf_dir, F.col("l_tax") * 10)
    net, shape = MLP("regression", hidden_dim=2, n_layers=1, dropout=0.0, batch_norm=False), Shape(2, 1, 2, 1, 0.0, False)
    state = MLPState.start(np.array([0.3, -0.2, 0.1, 0.4, 0.05, -0.1037, 0.5, -0.3, 0.2]), shape.stats())
    n, sums = summed_step(rows, 0, lambda x, y, block: net.contribution(shape, state, x, y))
    after = net.move(state, sums / n, shape.stats(), 0.01)
    out = [(i, round(float(g), 8), round(float(w), 8)) for i, (g, w) in enumerate(zip(sums / n, after.weights))]
    return spark.createDataFrame(out, "position int, gradient double, weight double")


@query("boosting_leaf_quantiles", """SELECT cast(l_linenumber AS INTEGER) AS leaf, round(quantile_cont(l_extendedprice - 50000, 0.9), 4) AS value FROM lineitem GROUP BY 1""")
def boosting_leaf_quantiles(spark, sf_dir):
    """Residual quantile per leaf, as the quantile booster sets its leaf values."""
    r = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("int").alias("leaf"), (F.col("l_extendedprice") - 50000).alias("residual"))
    return trees.leaf_quantiles(r, 0.9).select("leaf", F.round("value", 4).alias("value"))


@query("boosting_histogram_split", """WITH r AS (SELECT l_quantity AS x, CASE WHEN l_discount * 10 + l_quantity / 50 > 1 THEN 1e0 ELSE 0e0 END - 0.5e0 AS g FROM lineitem),
  b AS (SELECT x, sum(-g) AS g, count(*) * 0.25e0 AS h FROM r GROUP BY x),
  c AS (SELECT x, sum(g) OVER (ORDER BY x) AS gl, sum(h) OVER (ORDER BY x) AS hl, sum(g) OVER () AS g, sum(h) OVER () AS h FROM b),
  s AS (SELECT x, gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1) AS gain FROM c WHERE hl >= 1 AND h - hl >= 1)
  SELECT x AS cut, round(gain, 4) AS gain FROM s ORDER BY s.gain DESC, x LIMIT 1""")
def boosting_histogram_split(spark, sf_dir):
    """Root split of the booster on one feature: cut value and gain."""
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    rows = li.select(key.alias("row_id"), F.array("l_quantity").alias("features"),
                     (F.col("l_discount") * 10 + F.col("l_quantity") / 50 > 1).cast("double").alias(TARGET))
    booster = trees.Booster("classification", rounds=1, max_depth=1, l2=1.0, min_rows=1, min_child_weight=1.0)
    edges = trees.bin_edges(rows, 1, 255)
    state = trees.binned(rows, edges).withColumn("raw", F.array(F.lit(0.0)))
    units = trees.Units.of(rows.count(), 1.0)
    sums = booster._node_sums(state, [trees.Tree()], [[(0, -1, -1)]], [np.arange(1)], 0, units, [])
    (best,) = booster._best_splits(sums, units).collect()
    return spark.createDataFrame([(float(edges[0][best["bin"]]), round(best["gain"], 4))], "cut double, gain double")


def _best_first_round(r: int, rate: str) -> str:
    """CTEs of one boosting round on cells(x, n, s, raw): the best cut, the better cut of its sides, three leaf values."""
    gain = "gl * gl / nl + (g - gl) ** 2 / (n - nl) - g * g / n"

    def scan(cells: str, part: str) -> str:
        return (f"SELECT x{part and ', side'}, sum(g) OVER ({part} ORDER BY x) AS gl, sum(n) OVER ({part} ORDER BY x) AS nl, "
                f"sum(g) OVER ({part}) AS g, sum(n) OVER ({part}) AS n FROM {cells}")

    return f"""c{r} AS (SELECT x, n, s, raw, n * raw - s AS g FROM cells{r}),
  a{r} AS (SELECT x AS first FROM ({scan(f'c{r}', '')}) WHERE n > nl ORDER BY {gain} DESC, x LIMIT 1),
  d{r} AS (SELECT c{r}.*, x > first AS side FROM c{r}, a{r}),
  b{r} AS (SELECT side AS part, x AS next FROM ({scan(f'd{r}', 'PARTITION BY side')}) WHERE n > nl ORDER BY {gain} DESC, side, x LIMIT 1),
  cells{r + 1} AS (SELECT x, n, s, raw - {rate} * sum(g) OVER leaf / sum(n) OVER leaf AS raw FROM d{r}, b{r}
    WINDOW leaf AS (PARTITION BY side, side = part AND x > next))"""


@query("boosting_two_rounds", f"""WITH y AS (SELECT l_quantity AS x, cast(l_extendedprice AS DOUBLE) AS y FROM lineitem),
  cells0 AS (SELECT x, count(*) AS n, sum(y) AS s, (SELECT avg(y) FROM y) AS raw FROM y GROUP BY x),
  {_best_first_round(0, "0.5e0")}, {_best_first_round(1, "0.5e0")}
  SELECT cast(x AS DOUBLE) AS quantity, round(raw, 1) AS pred FROM cells2""")
def boosting_two_rounds(spark, sf_dir):
    """Prediction per quantity after two rounds of trees grown best first to three leaves."""
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    features = F.array(F.col("l_quantity").cast("double")).alias("features")
    rows = li.select(key.alias("row_id"), features, F.col("l_extendedprice").cast("double").alias(TARGET))
    booster = trees.Booster("regression", rounds=2, learning_rate=0.5, max_leaves=3, min_rows=1)
    seen = li.select(features).distinct()
    return booster.fit(rows).predict(seen).select(F.get("features", F.lit(0)).alias("quantity"), F.round("pred", 1).alias("pred"))


# ---------------------------------------------------------------- studies


@query("experiment_baseline_linear")
def experiment_baseline(spark, sf_dir):
    """Five outer folds of ridge with default parameters on parts."""
    e = experiment.run_experiment(dataset(spark, sf_dir, "part_reg"), "linear", mode="baseline", measure_cost=False)
    return e.aggregated.filter(~F.col("metric").contains("seconds"))


@query("experiment_efficiency_costs")
def experiment_costs(spark, sf_dir):
    """Fit time, model size and scoring latency of one fold."""
    e = experiment.run_experiment(dataset(spark, sf_dir, "doc_quality"), "linear", mode="baseline", folds=[0])
    return e.metrics.filter(F.col("name").isin("fit_seconds", "model_size_mb", "latency_ms_per_1k"))


@query("experiment_automated_search")
def experiment_automated(spark, sf_dir):
    """Search on one outer fold, beyond the start-up trials and without a time limit, then refit and score."""
    budget = {"n_trials": 6, "timeout_s": float("inf"), "inner_folds": 2}
    e = experiment.run_experiment(
        dataset(spark, sf_dir, "part_reg"), "linear", mode="automated", budget=budget, measure_cost=False, folds=[0])
    return e.aggregated.filter(~F.col("metric").contains("seconds"))


_TRIAL_ALPHAS = (0.0001, 0.01, 1.0, 10.0, 100.0, 1000.0, 10000.0, 100000.0)


@query("search_trial_scores", with_cte("line_reg", extra=_FOLDED.split(",\n  w AS")[0].replace("% 5", "% 3").replace("[0, 1, 2, 3, 4]", "[0, 1, 2]").replace("l_extendedprice", "l_quantity")) + f"""SELECT cast(t AS INTEGER) AS trial, fold,
  round(-sqrt(avg((__target__ - (my - mx * sxy / (sxx + alpha)) - sxy / (sxx + alpha) * (l_quantity - c) / sd) ** 2)), 3) AS score
  FROM f JOIN p ON p.s = fold JOIN m ON m.s = fold, (SELECT unnest({list(range(len(_TRIAL_ALPHAS)))}) AS t, unnest({list(_TRIAL_ALPHAS)}) AS alpha) GROUP BY t, fold""")
def search_trial_scores(spark, sf_dir):
    """Eight ridge trials on three inner folds: every score from the Gram blocks of each fold's two sides."""
    df = dataset(spark, sf_dir, "line_reg").df.select("row_id", "l_quantity", TARGET)
    folded = splits.kfold(df, 42, "regression", 3).persist()
    pairs = [splits.fold_sides(folded, fold) for fold in range(3)]
    base = {"numeric_imputer": "mean", "scaler": "standard", "cat_encoder": "onehot"}
    search_of = objective.Objective(pairs, "regression", "linear", 42, [], base)
    trials = [(t, {"model.alpha": a}) for t, a in enumerate(_TRIAL_ALPHAS)]
    out = [(t, fold, round(score, 3)) for fold in range(3) for t, score in search_of.scores(fold, trials).items()]
    search_of.close()
    folded.unpersist()
    return spark.createDataFrame(out, "trial int, fold int, score double")


@query("search_proposed_trials")
def search_proposed(spark, sf_dir):
    """Proposals from a history whose values come from the tables."""
    target = spark.createDataFrame([("line_cls", "hist_gb", "classification", "medium", True)],
                                   "dataset string, model string, task string, tier string, has_categorical boolean")
    space = search_space(spark, target)
    drawn = search.sample_trials(space, 7, 3)
    scores = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("int").alias("trial")).agg(
        F.avg("l_discount").alias("value"))
    history = drawn.join(scores, "trial").select("trial", "params", "value")
    return search.propose(space, history, 3, 3, 7)


@query("scaling_subset_sizes", with_cte("part_reg") + """SELECT fraction, cast(least(greatest(floor(n * fraction), 50), n) AS BIGINT) AS n_rows FROM (SELECT count(*) AS n FROM part_reg),
  (SELECT unnest([0.01e0, 0.05e0, 0.1e0, 0.33e0, 1e0]) AS fraction)""")
def scaling_subset_sizes(spark, sf_dir):
    return scaling.subset_sizes(dataset(spark, sf_dir, "part_reg").df, splits.SCALING_FRACTIONS, 42)


@query("scaling_study_ridge")
def scaling_study_ridge(spark, sf_dir):
    out = scaling.scaling_study(dataset(spark, sf_dir, "part_reg"), ["linear"], [0.33, 1.0])
    return out.select("dataset", "model", "fraction", "n_rows", "primary")


@query("audit_repeated_run")
def audit_repeated_run(spark, sf_dir):
    """The same baseline experiment, over all its outer folds, twice: largest difference of its quality metrics."""
    ds: Dataset = dataset(spark, sf_dir, "doc_quality")

    def once():
        e = experiment.run_experiment(ds, "linear", mode="baseline", measure_cost=False)
        return e.aggregated.withColumnRenamed("metric", "name")

    return audit.repro_audit(once)


@query("leakage_fold_parameters", with_cte("line_reg", extra=_FOLDED.format(alpha="1e0")) + "SELECT count(DISTINCT round(c, 6)) AS n_means, 5 AS folds FROM p")
def leakage_fold_parameters(spark, sf_dir):
    """Parameters of different training sets differ: test rows never enter them."""
    fitted = preprocess.numeric_parameters(_folded_price(spark, sf_dir), ["l_extendedprice"], "mean", "standard", k=5)
    t = preprocess.fold_parameter_table(spark, fitted)
    return t.agg(F.count_distinct(F.round("center", 6)).alias("n_means"), F.count_distinct("fold").cast("int").alias("folds"))

