"""Persisted folds: one parquet table partitioned by dataset, seed and row count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from foldwright.operators.columns import TARGET
from foldwright.operators.splits import outer_folds

SCHEMA = "row_id string, fold int, dataset string, seed int, n_rows long"


def load_splits(
    spark: SparkSession, path: str, dataset: str, seed: int, n_rows: int
) -> DataFrame | None:
    """Stored folds of one (dataset, seed, n_rows); reads only that partition."""
    try:
        stored = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException:
        return None
    mine = stored.filter(
        (F.col("dataset") == dataset) & (F.col("seed") == seed) & (F.col("n_rows") == n_rows)
    ).select("row_id", "fold")
    return None if mine.isEmpty() else mine


def save_splits(folds: DataFrame, path: str, dataset: str, seed: int, n_rows: int) -> None:
    folds.select(
        "row_id", "fold", F.lit(dataset).alias("dataset"), F.lit(seed).alias("seed"),
        F.lit(n_rows).cast("long").alias("n_rows"),
    ).write.mode("append").partitionBy("dataset", "seed", "n_rows").parquet(path)


def get_splits(
    df: DataFrame, path: str, dataset: str, task: str, seed: int, n_rows: int
) -> DataFrame:
    """Outer folds, computed once per key and read back afterwards."""
    spark = df.sparkSession
    found = load_splits(spark, path, dataset, seed, n_rows)
    if found is None:
        save_splits(outer_folds(df.select("row_id", TARGET), seed, task, n_rows), path, dataset, seed, n_rows)
        found = load_splits(spark, path, dataset, seed, n_rows)
    return found
