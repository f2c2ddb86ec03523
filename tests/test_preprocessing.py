import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from foldwright.functions import scalar
from foldwright.operators import preprocess, splits, traits
from foldwright.operators.columns import TARGET, downcast, encode_target, split_columns
from foldwright.sources.datasets import dataset


@pytest.fixture(scope="module")
def mixed(spark):
    """Five columns: clean, skewed and gappy numbers, few and many categories."""
    u = lambda name: scalar.hash_unit(F.lit(name), F.col("id"))
    normal = lambda name: F.expr(scalar.normal_ppf_sql(f"({name})"))
    base = spark.range(400).select(
        F.col("id").cast("string").alias("row_id"), "id",
        *[F.greatest(u(n), F.lit(1e-6)).alias(n) for n in ("a", "b", "c")])
    return base.select(
        "row_id",
        normal("a").alias("num_clean"),
        F.exp(3 * normal("b")).alias("num_skewed"),
        F.when(F.col("id") % 5 != 0, normal("c")).alias("num_missing"),
        F.concat(F.lit("low"), (F.col("id") % 3).cast("string")).alias("cat_low"),
        F.concat(F.lit("high"), (F.col("id") % 40).cast("string")).alias("cat_high"),
        (F.col("id") % 2).alias(TARGET),
    ).persist()


def features(df):
    return df.drop("row_id", TARGET)


def test_automatic_decisions(mixed):
    row = traits.resolve_auto(traits.traits(features(mixed))).first()
    assert row["n_numeric"] == 3 and row["n_categorical"] == 2
    assert abs(row["missing_fraction"] - 0.04) < 1e-9
    assert (row["numeric_imputer"], row["scaler"], row["cat_encoder"]) == ("median", "quantile", "target")
    assert set(row["reasons"]) == {"numeric_imputer", "scaler", "cat_encoder"}


def test_few_categories_give_onehot_and_pins_override(mixed):
    low = features(mixed).drop("cat_high")
    assert traits.resolve_auto(traits.traits(low)).first()["cat_encoder"] == "onehot"
    pinned = traits.resolve_auto(traits.traits(low), "mean", "none", "ordinal").first()
    assert (pinned["numeric_imputer"], pinned["scaler"], pinned["cat_encoder"]) == ("mean", "none", "ordinal")
    assert pinned["reasons"] == {}


@pytest.mark.parametrize("scaler,encoder", [("standard", "onehot"), ("robust", "ordinal"), ("quantile", "target"), ("none", "onehot")])
def test_output_is_complete_and_finite(mixed, scaler, encoder):
    numeric, categorical = split_columns(features(mixed))
    fitted = preprocess.Preprocessor(numeric, categorical, "classification", "median", scaler, encoder).fit(mixed)
    out = fitted.transform(mixed, training=True)
    assert out.count() == 400
    bad = out.filter(F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > 1e12)))
    assert bad.isEmpty()
    assert len(out.first()["features"]) == len(fitted.feature_names)


def test_shuffled_lookup_equals_broadcast_lookup(mixed, monkeypatch):
    df = mixed.select("row_id", TARGET, "cat_high")
    fitted = preprocess.Preprocessor([], ["cat_high"], "classification", cat_encoder="ordinal").fit(df)
    wide = {r["row_id"]: r["features"] for r in fitted.transform(df).collect()}
    monkeypatch.setattr(preprocess, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(preprocess, "LOCAL_ROWS", 0)
    again = preprocess.Preprocessor([], ["cat_high"], "classification", cat_encoder="ordinal").fit(df)
    assert again.hot["cat_high"]
    assert {r["row_id"]: r["features"] for r in again.transform(df).collect()} == wide


def test_fold_parameters_leave_test_rows_out(spark):
    df = spark.createDataFrame([(str(i), float(i), i % 2) for i in range(10)], "row_id string, x double, fold int")
    fitted = preprocess.numeric_parameters(df, ["x"], "median", "standard", k=2)
    assert [p["x"].center for p in fitted] == [5.0, 4.0]
    assert [p["x"].fill for p in fitted] == [5.0, 4.0]


def test_all_null_column_is_dropped_and_constant_has_unit_scale(spark):
    df = spark.createDataFrame([("1", None, 2.0), ("2", None, 2.0)], "row_id string, a double, b double")
    params = preprocess.numeric_parameters(df, ["a", "b"])[0]
    assert params["a"].fill is None and params["b"].scale == 1.0
    assert preprocess.apply_numeric(df, params, "standard")[1] == ["b"]


def test_target_encoding_crossfit_differs_from_full_fit(spark, sf_dir):
    df = encode_target(dataset(spark, sf_dir, "part_reg").df, "regression").select("row_id", TARGET, "p_brand")
    fitted = preprocess.Preprocessor([], ["p_brand"], "regression", cat_encoder="target").fit(df)
    a = {r["row_id"]: r["features"] for r in fitted.transform(df, training=True).collect()}
    b = {r["row_id"]: r["features"] for r in fitted.transform(df).collect()}
    assert a.keys() == b.keys() and a != b
    unseen = fitted.transform(df.withColumn("p_brand", F.lit("new"))).first()["features"][0]
    assert abs(unseen - df.agg(F.avg(TARGET)).first()[0]) < 1e-6


def test_normal_functions(spark):
    ps = [1e-9, 0.01, 0.3, 0.5, 0.9, 0.999999]
    rows = spark.createDataFrame([(p, NormalDist().inv_cdf(p)) for p in ps], "p double, z double")
    for r in rows.select("p", "z", scalar.normal_ppf("p").alias("ppf"), scalar.normal_tail("z").alias("tail")).collect():
        assert abs(r["ppf"] - r["z"]) < 1e-9
        assert math.isclose(r["tail"], min(r["p"], 1 - r["p"]), rel_tol=1e-7)


def test_downcast_picks_the_smallest_width(spark):
    df = spark.createDataFrame([(1, 300, 2**40, 1.5)], "a long, b long, c long, d double")
    assert dict(downcast(df).dtypes) == {"a": "tinyint", "b": "smallint", "c": "bigint", "d": "float"}


def test_child_seeds_are_distinct_and_fixed(spark):
    seeds = [r[0] for r in spark.range(50).select(scalar.child_seed(42, F.col("id"))).collect()]
    assert len(set(seeds)) == 50
    assert seeds == [r[0] for r in spark.range(50).select(scalar.child_seed(42, F.col("id"))).collect()]
