"""Queries over preprocessing: imputation, scaling, encoding, fold parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.catalog.base import query
from foldwright.catalog.fixtures import with_cte
from foldwright.functions import scalar
from foldwright.operators import preprocess, splits
from foldwright.operators.columns import TARGET, encode_target
from foldwright.sources.datasets import dataset

_NUM = ["l_extendedprice", "l_quantity", "l_discount", "l_tax_n"]
_AS_LONG = " UNION ALL ".join(f"SELECT row_id, '{c}' AS feature, {c} AS v FROM {{t}}" for c in _NUM)


def _numbers(spark, sf_dir, imputer, scaler, name="line_reg", numeric=_NUM, **kw):
    df = dataset(spark, sf_dir, name).df
    fitted = preprocess.numeric_parameters(df, numeric, imputer, scaler, **kw)[0]
    return preprocess.apply_numeric(df, fitted, scaler)[0].select("row_id", *numeric)


@query("impute_median", with_cte("line_reg") + """SELECT row_id,
  coalesce(l_tax_n, (SELECT quantile_cont(l_tax_n, 0.5) FROM line_reg)) AS l_tax_n FROM line_reg""")
def impute_median(spark, sf_dir):
    return _numbers(spark, sf_dir, "median", "none").select("row_id", "l_tax_n")


@query("impute_mean", with_cte("line_reg") + """SELECT row_id,
  round(coalesce(l_tax_n, (SELECT avg(l_tax_n) FROM line_reg)), 6) AS l_tax_n FROM line_reg""")
def impute_mean(spark, sf_dir):
    out = _numbers(spark, sf_dir, "mean", "none")
    return out.select("row_id", F.round("l_tax_n", 6).alias("l_tax_n"))


@query("impute_most_frequent", with_cte("line_reg", extra="""g AS (SELECT row_id,
    CASE WHEN l_quantity < 10 THEN NULL ELSE l_returnflag END AS flag FROM line_reg),
  m AS (SELECT flag FROM g WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)""")
  + "SELECT row_id, coalesce(flag, (SELECT flag FROM m)) AS flag FROM g")
def impute_most_frequent(spark, sf_dir):
    df = dataset(spark, sf_dir, "line_reg").df.select(
        "row_id", F.when(F.col("l_quantity") >= 10, F.col("l_returnflag")).alias("flag"))
    counts = preprocess.category_counts(df, ["flag"])
    fills = {r["feature"]: r["fill"] for r in preprocess.most_frequent(counts).collect()}
    return preprocess.fill_categories(df, fills)


_FILLED = "fl AS (SELECT row_id, " + ", ".join(
    f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM line_reg)) AS {c}" for c in _NUM) + " FROM line_reg)"


@query("scale_standard", with_cte("line_reg", extra=_FILLED) + "SELECT row_id, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM fl)) / (SELECT stddev_pop({c}) FROM fl), 6) AS {c}" for c in _NUM) + " FROM fl")
def scale_standard(spark, sf_dir):
    out = _numbers(spark, sf_dir, "median", "standard")
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in _NUM])


@query("scale_robust", with_cte("line_reg", extra=_FILLED) + "SELECT row_id, " + ", ".join(
    f"round(({c} - (SELECT quantile_cont({c}, 0.5) FROM fl)) / (SELECT quantile_cont({c}, 0.75) "
    f"- quantile_cont({c}, 0.25) FROM fl), 6) AS {c}" for c in _NUM) + " FROM fl")
def scale_robust(spark, sf_dir):
    out = _numbers(spark, sf_dir, "median", "robust")
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in _NUM])


_POSITION = """q AS (SELECT quantile_cont(value3, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM event_skew),
  u AS (SELECT row_id, CASE WHEN value3 - 1e-7 < q[1] THEN 0e0 WHEN value3 + 1e-7 > q[5] THEN 1e0
    WHEN value3 < q[2] THEN (value3 - q[1]) / (q[2] - q[1]) * 0.25e0
    WHEN value3 < q[3] THEN 0.25e0 + (value3 - q[2]) / (q[3] - q[2]) * 0.25e0
    WHEN value3 < q[4] THEN 0.5e0 + (value3 - q[3]) / (q[4] - q[3]) * 0.25e0
    ELSE 0.75e0 + (value3 - q[4]) / (q[5] - q[4]) * 0.25e0 END AS p FROM event_skew, q),
  c AS (SELECT row_id, least(greatest(p, 1e-7), 1e0 - 1e-7) AS p FROM u)"""


@query("scale_quantile_normal", with_cte("event_skew", extra=_POSITION)
       + f"SELECT row_id, round({scalar.normal_ppf_sql('p')}, 5) AS value3 FROM c")
def scale_quantile(spark, sf_dir):
    out = _numbers(spark, sf_dir, "median", "quantile", "event_skew", ["value3"], n_quantiles=5)
    return out.select("row_id", F.round("value3", 5).alias("value3"))


def _encoded(spark, sf_dir, name, categorical, encoder, training=False):
    ds = dataset(spark, sf_dir, name)
    df = encode_target(ds.df, ds.task).select("row_id", TARGET, *categorical)
    prep = preprocess.Preprocessor([], categorical, ds.task, cat_encoder=encoder, seed=7)
    fitted = prep.fit(df)
    return fitted.transform(df, training=training)


_SLOTS = """n AS (SELECT props, count(*) AS n FROM event_skew GROUP BY 1),
  t AS (SELECT sum(n) AS total FROM n),
  k AS (SELECT props, row_number() OVER (ORDER BY props) - 1 AS slot FROM n, t WHERE n >= 0.01e0 * total),
  s AS (SELECT row_id, coalesce(slot, (SELECT count(*) FROM k)) AS slot FROM event_skew LEFT JOIN k USING (props))"""


@query("encode_onehot_with_rare", with_cte("event_skew", extra=_SLOTS)
       + "SELECT row_id, cast(slot AS INTEGER) AS slot, 1e0 AS total FROM s")
def encode_onehot(spark, sf_dir):
    out = _encoded(spark, sf_dir, "event_skew", ["props"], "onehot")
    return out.select("row_id", scalar.argmax(F.col("features")).alias("slot"),
                      F.aggregate("features", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("encode_ordinal", with_cte("part_reg") + """SELECT row_id,
  cast(dense_rank() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS brand,
  cast(dense_rank() OVER (ORDER BY p_type) - 1 AS DOUBLE) AS type FROM part_reg""")
def encode_ordinal(spark, sf_dir):
    out = _encoded(spark, sf_dir, "part_reg", ["p_brand", "p_type"], "ordinal")
    return out.select("row_id", F.get("features", F.lit(0)).alias("brand"),
                      F.get("features", F.lit(1)).alias("type"))


_TE = """g AS (SELECT avg(__target__) AS m, var_pop(__target__) AS v FROM part_reg),
  c AS (SELECT p_brand, count(*) AS n, avg(__target__) AS cm, var_pop(__target__) AS cv FROM part_reg GROUP BY 1),
  e AS (SELECT p_brand, n * v / (n * v + cv) * cm + (1 - n * v / (n * v + cv)) * m AS enc FROM c, g)"""


@query("encode_target_smoothed", with_cte("part_reg", extra=_TE)
       + "SELECT row_id, round(enc, 4) AS brand FROM part_reg JOIN e USING (p_brand)")
def encode_target_smoothed(spark, sf_dir):
    out = _encoded(spark, sf_dir, "part_reg", ["p_brand"], "target")
    return out.select("row_id", F.round(F.get("features", F.lit(0)), 4).alias("brand"))


_TECF = """r AS (SELECT *, cast(('0x' || substr(md5('te7:' || row_id), 1, 7)) AS BIGINT) % 5 AS cf FROM part_reg),
  k AS (SELECT unnest([0, 1, 2, 3, 4]) AS f),
  g AS (SELECT f, avg(__target__) AS m, var_pop(__target__) AS v FROM r, k WHERE cf <> f GROUP BY f),
  c AS (SELECT f, p_brand, count(*) AS n, avg(__target__) AS cm, var_pop(__target__) AS cv FROM r, k
    WHERE cf <> f GROUP BY f, p_brand),
  e AS (SELECT f, p_brand, n * v / (n * v + cv) * cm + (1 - n * v / (n * v + cv)) * m AS enc FROM c JOIN g USING (f))"""


@query("encode_target_crossfitted", with_cte("part_reg", extra=_TECF) + """SELECT row_id,
  round(coalesce(enc, (SELECT avg(m) FROM g WHERE g.f = r.cf)), 4) AS brand FROM r
  LEFT JOIN e ON e.f = r.cf AND e.p_brand = r.p_brand""")
def encode_target_crossfitted(spark, sf_dir):
    out = _encoded(spark, sf_dir, "part_reg", ["p_brand"], "target", training=True)
    return out.select("row_id", F.round(F.get("features", F.lit(0)), 4).alias("brand"))


_FOLDED = """f AS (SELECT *, cast((row_number() OVER (ORDER BY md5('42:' || row_id), row_id) - 1) % 5 AS INTEGER)
  AS fold FROM line_reg), k AS (SELECT unnest([0, 1, 2, 3, 4]) AS s),
  tr AS (SELECT s, f.* FROM f, k WHERE fold <> s),
  fills AS (SELECT s, """ + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in _NUM) + """ FROM tr GROUP BY s),
  im AS (""" + " UNION ALL ".join(
    f"SELECT tr.s, '{c}' AS feature, coalesce(tr.{c}, fills.{c}) AS v, fills.{c} AS fill FROM tr JOIN fills USING (s)"
    for c in _NUM) + ")"


@query("fold_parameters_standard", with_cte("line_reg", extra=_FOLDED) + """SELECT cast(s AS INTEGER) AS fold, feature,
  round(max(fill), 6) AS fill, round(avg(v), 5) AS center, round(stddev_pop(v), 5) AS scale FROM im GROUP BY s, feature""")
def fold_parameters_standard(spark, sf_dir):
    return _fold_parameters(spark, sf_dir, "standard")


@query("fold_parameters_robust", with_cte("line_reg", extra=_FOLDED) + """SELECT cast(s AS INTEGER) AS fold, feature,
  round(max(fill), 6) AS fill, round(quantile_cont(v, 0.5), 5) AS center,
  round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 5) AS scale FROM im GROUP BY s, feature""")
def fold_parameters_robust(spark, sf_dir):
    return _fold_parameters(spark, sf_dir, "robust")


def _fold_parameters(spark, sf_dir, scaler):
    df = dataset(spark, sf_dir, "line_reg").df
    folded = splits.kfold(df.select("row_id", *_NUM), 42, "regression")
    fitted = preprocess.numeric_parameters(folded, _NUM, "median", scaler, k=5)
    return preprocess.fold_parameter_table(spark, fitted).select(
        "fold", "feature", F.round("fill", 6).alias("fill"), F.round("center", 5).alias("center"),
        F.round("scale", 5).alias("scale"))


@query("preprocess_full_line", with_cte("line_reg", extra=_FILLED + """,
  f1 AS (SELECT row_id, (l_quantity - (SELECT avg(l_quantity) FROM fl)) / (SELECT stddev_pop(l_quantity) FROM fl) AS q FROM fl)""")
  + """SELECT row_id, round(q, 6) AS quantity, cast(9 AS INTEGER) AS width, 2e0 AS ones,
  (l_returnflag = 'R')::INT::DOUBLE AS flag_r, (l_linestatus = 'O')::INT::DOUBLE AS status_o
  FROM line_reg JOIN f1 USING (row_id)""")
def preprocess_full(spark, sf_dir):
    ds = dataset(spark, sf_dir, "line_reg")
    prep = preprocess.Preprocessor(ds.numeric, ds.categorical, ds.task)
    out = prep.fit(ds.df).transform(ds.df)
    at = lambda i: F.get("features", F.lit(i))
    ones = F.aggregate(F.slice("features", 5, 5), F.lit(0.0), lambda a, b: a + b)
    return out.select("row_id", F.round(at(1), 6).alias("quantity"), F.size("features").alias("width"),
                      ones.alias("ones"), at(6).alias("flag_r"), at(8).alias("status_o"))


@query("category_lookup_unseen", with_cte("event_skew", extra="""f AS (SELECT *, (row_number() OVER (ORDER BY md5('42:' || row_id),
    row_id) - 1) % 5 AS fold FROM event_skew), tr AS (SELECT * FROM f WHERE fold <> 0 AND props <> '{"k": 7}'),
  k AS (SELECT props, cast(dense_rank() OVER (ORDER BY props) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT props FROM tr))""")
  + "SELECT row_id, coalesce(code, -1) AS code FROM event_skew LEFT JOIN k USING (props)")
def category_lookup_unseen(spark, sf_dir):
    df = dataset(spark, sf_dir, "event_skew").df.select("row_id", TARGET, "props")
    train = splits.fold_sides(splits.kfold(df, 42, "regression"), 0)[0].filter(F.col("props") != '{"k": 7}')
    prep = preprocess.Preprocessor([], ["props"], "classification", cat_encoder="ordinal")
    return prep.fit(train).transform(df).select("row_id", F.get("features", F.lit(0)).alias("code"))
