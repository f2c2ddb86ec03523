"""Readers: cached datasets, headerless CSV, scoring CSV, bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.operators.columns import TARGET, nan_to_null, split_target
from foldwright.operators.splits import stratified_subset
from foldwright.sources.registry import DatasetSpec


def read_headerless_csv(
    spark: SparkSession,
    path: str,
    n_columns: int,
    target: int = 0,
    has_header: bool = False,
) -> DataFrame:
    """Every column float32; target by position, the others named f0..f{d-1}.

    Compressed files are decoded by their suffix; the explicit schema avoids an
    extra pass over the file.
    """
    schema = T.StructType([T.StructField(f"c{i}", T.FloatType()) for i in range(n_columns)])
    raw = spark.read.schema(schema).option("header", has_header).csv(path)
    rest = [c for i, c in enumerate(raw.columns) if i != target]
    return raw.select(
        *[F.col(c).alias(f"f{i}") for i, c in enumerate(rest)],
        F.col(raw.columns[target]).alias(TARGET),
    )


def read_csv_features(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """Header CSV for scoring; the model's stored schema saves the inference pass."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_source(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """Raw table of a spec: parquet, CSV or ORC file, target named ``__target__``."""
    if spec.kind == "headerless_csv":
        return read_headerless_csv(
            spark, spec.location, spec.expected_features + 1, int(spec.target or 0)
        )
    if spec.kind == "csv":
        df = spark.read.options(header=True, inferSchema=True, **spec.options).csv(spec.location)
    elif spec.kind in ("parquet", "orc", "json"):
        df = spark.read.format(spec.kind).options(**spec.options).load(spec.location)
    else:
        raise ValueError(f"source kind {spec.kind!r} needs its rows given as a file")
    return split_target(df, spec.target)


def load_dataset(
    spark: SparkSession, cache_dir: str, spec: DatasetSpec, full: bool = False
) -> tuple[DataFrame, bool]:
    """(cached rows, is_subset): the local subset unless ``full`` or none is set."""
    df = nan_to_null(spark.read.parquet(f"{cache_dir}/{spec.name}"))
    n = spec.local_subset_rows
    if full or n is None or n >= spec.expected_rows:
        return df, False
    if "row_id" not in df.columns:
        raise ValueError("a subset needs the row_id key of the cached rows")
    return stratified_subset(df, n, spec.task), True


def map_batches(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str | T.StructType,
) -> DataFrame:
    """Apply ``fn`` to bounded Arrow batches; every row is in exactly one batch.

    The batch size is ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)


def batch_sizes(df: DataFrame) -> DataFrame:
    """Rows per Arrow batch: the bounded-batch iteration as a table."""

    def size(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"rows": pa.array([batch.num_rows], pa.int64())})

    return map_batches(df.select(df.columns[0]), size, "rows long")
