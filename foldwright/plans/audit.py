"""Reproducibility audit: the same configuration twice, largest metric difference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.plans.report import quality_metrics

TOLERANCE = 1e-9  # float sums depend on task order unless the layout is pinned


def largest_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n_metrics, max_delta) over metric names both sides have; no common name gives infinity."""
    joined = a.select("name", F.col("value").alias("x")).join(
        b.select("name", F.col("value").alias("y")), "name"
    )
    return joined.agg(
        F.count(F.lit(1)).alias("n_metrics"),
        F.coalesce(F.max(F.abs(F.col("x") - F.col("y"))), F.lit(float("inf"))).alias("max_delta"),
    )


def repro_audit(run, tolerance: float = TOLERANCE) -> DataFrame:
    """Call ``run()`` twice; each call returns (name, value) metric rows."""
    out = largest_delta(quality_metrics(run()), quality_metrics(run()))
    return out.withColumn("reproducible", F.col("max_delta") <= tolerance)
