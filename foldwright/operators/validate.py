"""Dataset checks: one aggregate per dataset, failures as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.operators.columns import TARGET
from foldwright.sources.registry import DatasetSpec

REPORT_COLUMNS = (
    "dataset", "rows", "features", "missing_fraction", "n_classes", "errors", "ok",
)


def validate(spec: DatasetSpec, df: DataFrame) -> DataFrame:
    """One report row for a dataset with ``__target__``.

    Class counting goes through ``groupBy(target)`` so that no task holds the
    whole set of target values.
    """
    features = [c for c in df.columns if c not in ("row_id", TARGET)]
    numeric_target = isinstance(df.schema[TARGET].dataType, T.NumericType)
    classification = spec.task == "classification"
    missing = reduce(
        lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in features], F.lit(0).cast("long")
    )
    counted = df.select(
        missing.alias("_missing"),
        F.col(TARGET).isNull().cast("long").alias("_no_target"),
        (F.col(TARGET) if classification else F.lit(0)).alias("_class"),
    )
    per_class = counted.groupBy("_class").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_missing").alias("missing"),
        F.sum("_no_target").alias("no_target"),
    )
    totals = per_class.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"),
        F.coalesce(F.sum("no_target"), F.lit(0)).alias("no_target"),
        F.count("_class").alias("classes"),
    )
    cells = F.col("rows") * len(features)
    n_classes = F.col("classes") if classification else F.lit(None).cast("long")
    errors = F.array_compact(
        F.array(
            F.when(
                F.col("rows") != spec.expected_rows,
                F.format_string(f"expected {spec.expected_rows} rows, found %d", "rows"),
            ),
            F.when(
                F.lit(len(features) != spec.expected_features),
                F.lit(f"expected {spec.expected_features} features, found {len(features)}"),
            ),
            F.when(F.col("no_target") > 0, F.format_string("%d missing targets", "no_target")),
            F.when(F.lit(classification) & (F.col("classes") < 2), F.lit("fewer than 2 classes")),
            F.when(
                F.lit(not classification and not numeric_target),
                F.lit("regression target is not numeric"),
            ),
        )
    )
    return (
        totals.withColumn("errors", errors)
        .select(
            F.lit(spec.name).alias("dataset"),
            "rows",
            F.lit(len(features)).cast("long").alias("features"),
            F.when(cells > 0, F.col("missing") / cells).otherwise(0.0).alias("missing_fraction"),
            n_classes.alias("n_classes"),
            "errors",
            (F.size("errors") == 0).alias("ok"),
        )
    )


def failure_row(spark: SparkSession, name: str, error: Exception) -> DataFrame:
    schema = (
        "dataset string, rows long, features long, missing_fraction double, n_classes long, "
        "errors array<string>, ok boolean"
    )
    return spark.createDataFrame([(name, None, None, None, None, [str(error)[:300]], False)], schema)


def validate_all(
    spark: SparkSession,
    specs: Iterable[DatasetSpec],
    load: Callable[[DatasetSpec], DataFrame],
    include_large: bool = False,
    only: Iterable[str] | None = None,
) -> DataFrame:
    """One row per dataset; a dataset that cannot be read becomes a failed row."""
    only = set(only) if only is not None else None
    reports = []
    for spec in specs:
        if only is not None and spec.name not in only:
            continue
        if only is None and not include_large and spec.tier == "large":
            continue
        try:
            reports.append(validate(spec, load(spec)))
        except Exception as error:  # noqa: BLE001 - a failure is a result row here
            reports.append(failure_row(spark, spec.name, error))
    return reduce(DataFrame.unionByName, reports)


def overall(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count(F.lit(1)).alias("datasets"),
        F.sum((~F.col("ok")).cast("long")).alias("failed"),
        F.bool_and("ok").alias("all_ok"),
    )
