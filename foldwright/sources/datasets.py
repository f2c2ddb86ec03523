"""Datasets derived by projection from star-schema parquet tables.

Each has a ``row_id`` key, typed feature columns and a ``__target__``; the
projections push down to the parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.operators.columns import TARGET, split_columns


@dataclass(frozen=True)
class Dataset:
    """Features, target and key of one study table."""

    name: str
    task: str
    df: DataFrame
    expected_rows: int | None = None
    is_subset: bool = False

    @property
    def features(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("row_id", TARGET)]

    @property
    def numeric(self) -> list[str]:
        return split_columns(self.df.select(*self.features))[0]

    @property
    def categorical(self) -> list[str]:
        return split_columns(self.df.select(*self.features))[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(*parts) -> F.Column:
    return F.concat_ws("-", *[p.cast("string") for p in parts])


def _line_key():
    return _key(
        F.col("l_orderkey"),
        F.col("l_partkey"),
        F.col("l_suppkey"),
        F.col("l_linenumber"),
        F.col("l_quantity").cast("int"),
    )


def _tax_with_gaps():
    return F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax"))


def line_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        _line_key().alias("row_id"),
        "l_extendedprice",
        "l_quantity",
        "l_discount",
        _tax_with_gaps().alias("l_tax_n"),
        "l_returnflag",
        "l_linestatus",
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias(TARGET),
    )


def line_cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = (
        F.col("l_discount") * 10
        + F.col("l_quantity") / 50
        + F.when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0)
    )
    return table(spark, sf_dir, "lineitem").select(
        _line_key().alias("row_id"),
        "l_discount",
        "l_quantity",
        _tax_with_gaps().alias("l_tax_n"),
        "l_extendedprice",
        "l_returnflag",
        "l_linestatus",
        F.when(score > 1.15, "1").otherwise("0").alias(TARGET),
    )


def order_cls3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("row_id"),
        "o_totalprice",
        "o_orderpriority",
        F.month("o_orderdate").alias("o_month"),
        F.col("o_orderstatus").alias(TARGET),
    )


def event_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("row_id"),
        "value",
        (value * value * value).alias("value3"),
        "props",
        F.col("event_type").alias(TARGET),
    )


def event_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("row_id"),
        "value",
        F.col("event_type").alias(TARGET),
    )


def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    # Both sides grow with the corpus, and every pass over the rows would send the labels through the driver again.
    return docs.join(labels.hint("shuffle_merge"), "doc_id").select(
        F.col("doc_id").cast("string").alias("row_id"),
        "n_chars",
        "lang",
        "source",
        F.col("quality").cast("string").alias(TARGET),
    )


def part_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("row_id"),
        "p_brand",
        "p_type",
        "p_size",
        F.col("p_retailprice").alias(TARGET),
    )


def embed_cls10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("row_id"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)],
        F.col("label").cast("string").alias(TARGET),
    )


BUILDERS = {
    "line_reg": ("regression", line_reg),
    "line_cls": ("classification", line_cls),
    "order_cls3": ("classification", order_cls3),
    "event_skew": ("classification", event_skew),
    "event_std": ("classification", event_std),
    "doc_quality": ("classification", doc_quality),
    "part_reg": ("regression", part_reg),
    "embed_cls10": ("classification", embed_cls10),
}


def dataset(spark: SparkSession, sf_dir: str, name: str) -> Dataset:
    if name not in BUILDERS:
        raise KeyError(f"no dataset {name!r}; known datasets: {', '.join(sorted(BUILDERS))}")
    task, build = BUILDERS[name]
    return Dataset(name, task, build(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction table over line_cls: row_id, run, fold, y, pred, proba."""
    p = F.round(
        1 / (1 + F.exp(-8 * (F.col("l_discount") * 10 + F.col("l_quantity") / 50 - 1))), 6
    )
    base = line_cls(spark, sf_dir).select(
        "row_id",
        F.col("l_returnflag").alias("run"),
        (F.col("l_quantity").cast("int") % 5).alias("fold"),
        F.col(TARGET).cast("int").alias("y"),
        p.alias("p1"),
    )
    return base.select(
        "row_id",
        "run",
        "fold",
        "y",
        (F.col("p1") > 0.5).cast("int").alias("pred"),
        F.array(1 - F.col("p1"), F.col("p1")).alias("proba"),
    )


MODES = ("automated", "baseline_default", "baseline_expert")


def study_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy run table whose scores are aggregates over lineitem groups.

    Scores are multiples of 2^-20 made from exact integer sums, so that sums over
    seeds are exact too and ties do not depend on summation order.
    """
    discount = F.round(F.col("l_discount") * 100).cast("long")
    tax = F.round(F.col("l_tax") * 100).cast("long")
    quantity = F.col("l_quantity").cast("long")
    keyed = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("ds_"), F.col("l_returnflag"), F.col("l_linestatus")).alias("dataset"),
        F.element_at(
            F.array(F.lit("linear"), F.lit("hist_gb"), F.lit("xgboost")),
            (F.col("l_partkey") % 3 + 1).cast("int"),
        ).alias("model"),
        F.element_at(
            F.array(*[F.lit(m) for m in MODES]), (F.col("l_suppkey") % 3 + 1).cast("int")
        ).alias("mode"),
        (F.col("l_orderkey") % 3 + 42).cast("int").alias("seed"),
        F.when(F.col("l_returnflag") == "R", "regression")
        .otherwise("classification")
        .alias("task"),
        F.when(F.col("l_linestatus") == "O", "small").otherwise("medium").alias("tier"),
        discount.alias("d"),
        tax.alias("t"),
        quantity.alias("q"),
    )
    runs = keyed.groupBy("dataset", "model", "mode", "seed", "task", "tier").agg(
        (F.floor(F.sum("d") * 2**20 / (F.count(F.lit(1)) * 10)) / 2.0**20).alias("score"),
        (F.floor(F.sum("t") * 2**20 / (F.count(F.lit(1)) * 100)) / 2.0**20).alias("err"),
        (F.floor(F.sum("q") * 2**20 / F.count(F.lit(1))) / 2.0**20).alias("secs"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    classification = F.col("task") == "classification"
    automated = F.col("mode") == "automated"
    return runs.select(
        F.concat_ws("__", "dataset", "model", "mode", F.col("seed").cast("string")).alias("run_id"),
        "dataset",
        "model",
        "mode",
        "seed",
        "tier",
        "task",
        F.when(classification, F.col("score")).alias("roc_auc_mean"),
        F.when(~classification, -F.col("score")).alias("neg_rmse_mean"),
        F.when(classification, F.col("err")).alias("ece_mean"),
        F.when(classification, F.col("err") * 2).alias("brier_mean"),
        F.when(~classification & (F.col("model") == "hist_gb"), F.col("err") * 10).alias("picp_80_mean"),
        F.when(~classification & (F.col("model") == "hist_gb"), F.col("secs") / 10).alias("mpiw_80_norm_mean"),
        F.when(automated, F.col("secs")).alias("hpo_seconds_total"),
        (F.col("secs") / 100).alias("fit_seconds_mean"),
        (F.col("n_rows") / 1000).alias("model_size_mb_mean"),
        (F.col("secs") * 2).alias("latency_ms_per_1k_mean"),
        F.when(classification, F.col("score")).otherwise(-F.col("score")).alias("primary"),
    )
