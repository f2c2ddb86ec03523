"""Structured Streaming forms: bounded batches, incremental training, scoring, traits.

State that survives a micro-batch is a table keyed by batch id in the shared
folder: a replayed batch overwrites its own row, so results do not double.
"""

from __future__ import annotations


from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.models.sgd import SGD, SGDModel, SGDState
from foldwright.session import scratch_path


def stream_batches(
    spark: SparkSession, pattern: str, schema: T.StructType, files_per_batch: int = 1
) -> DataFrame:
    """Parquet files matching a glob as a stream of bounded micro-batches."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    )


def for_each_batch(
    stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str | None = None
) -> None:
    """Run ``fn`` on every available micro-batch, then stop."""
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "stream")
    query = (
        stream.writeStream.foreachBatch(fn)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def batch_totals(stream: DataFrame, path: str | None = None) -> DataFrame:
    """(batch_id, rows) of each micro-batch."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "totals")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(
            f"{path}/batch_id={batch_id}")

    for_each_batch(stream, write)
    return spark.read.parquet(path)


def partial_fit_stream(
    stream: DataFrame, model: SGD, path: str | None = None, checkpoint: str | None = None
) -> SGDModel:
    """Out-of-core training: one weighted update per micro-batch.

    Micro-batches have row_id, __target__ and features. The weights after each
    batch are stored under its id, and a batch starts from the latest weights
    stored under a smaller one, so empty batches, replays and restarts with the
    same path and checkpoint continue the same training.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "weights")
    stored = "steps double, outputs int, weights array<double>"

    def load(below: int | None = None) -> SGDState | None:
        rows = spark.read.schema(f"{stored}, batch_id int").option("basePath", path).parquet(f"{path}/batch_id=*")
        if below is not None:
            rows = rows.where(F.col("batch_id") < below)
        r = rows.orderBy(F.desc("batch_id")).first()
        return None if r is None else SGDState(np.asarray(r["weights"]).reshape(r["outputs"], -1), r["steps"])

    def save(state: SGDState, batch_id: int) -> None:
        row = [(float(state.steps), state.weights.shape[0], [float(v) for v in state.weights.reshape(-1)])]
        spark.createDataFrame(row, stored).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    # an empty table, so that the folder can be read before the first batch
    spark.createDataFrame([], stored).write.mode("overwrite").parquet(f"{path}/batch_id=-1")

    def update(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        state = model.partial_fit(batch.persist(), load(batch_id))
        batch.unpersist()
        save(state, batch_id)

    for_each_batch(stream, update, checkpoint)
    last = load()
    if last is None:
        raise ValueError("no weights to return: neither this stream nor an earlier run had rows")
    return SGDModel(model.task, last.weights)


def score_stream(
    stream: DataFrame, predict: Callable[[DataFrame], DataFrame], output: str, checkpoint: str
) -> None:
    """Append predictions of a stream to parquet; exactly once by checkpoint."""
    query = (
        predict(stream)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def incremental_traits(stream: DataFrame, numeric: list[str], path: str | None = None) -> DataFrame:
    """(feature, n, nulls, mean, variance, skewness) merged over micro-batches.

    Each batch stores central moments per feature; they merge exactly, so the
    result equals the one-pass traits of all rows.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "moments")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch_moments(batch, numeric).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    for_each_batch(stream, write)
    return merged_traits(spark.read.parquet(path))


def batch_moments(batch: DataFrame, numeric: list[str]) -> DataFrame:
    """Per feature: n, nulls, mean and central sums of order 2 and 3."""
    n = F.count(F.lit(1))
    stats = batch.agg(
        n.alias("rows"),
        *[
            F.struct(
                F.count(c).alias("n"),
                F.avg(F.col(c).cast("double")).alias("mean"),
                F.var_pop(F.col(c).cast("double")).alias("var"),
                F.skewness(F.col(c).cast("double")).alias("skew"),
            ).alias(c)
            for c in numeric
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(c)["n"].alias("n"),
                (F.col("rows") - F.col(c)["n"]).alias("nulls"),
                F.col(c)["mean"].alias("mean"),
                (F.col(c)["var"] * F.col(c)["n"]).alias("m2"),
                F.coalesce(
                    F.col(c)["skew"] * F.pow(F.col(c)["var"], F.lit(1.5)) * F.col(c)["n"], F.lit(0.0)
                ).alias("m3"),
            )
            for c in numeric
        ]
    )
    return stats.select(F.inline(rows)).filter("n > 0 OR nulls > 0")


def merged_traits(parts: DataFrame) -> DataFrame:
    """Shift every batch's central sums to the overall mean and add them up."""
    whole = parts.groupBy("feature").agg(
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("center")
    )
    d = F.coalesce(F.col("mean"), F.col("center")) - F.col("center")
    n, m2, m3 = F.col("n"), F.coalesce("m2", F.lit(0.0)), F.col("m3")
    # One row per feature.
    shifted = parts.join(F.broadcast(whole), "feature")
    sums = shifted.groupBy("feature").agg(
        F.sum("n").alias("n"),
        F.sum("nulls").alias("nulls"),
        F.max("center").alias("mean"),
        F.sum(m2 + n * d * d).alias("s2"),
        F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("s3"),
    )
    size = F.col("n")
    variance = F.try_divide(F.col("s2"), size)
    g1 = F.try_divide(F.col("s3"), size) / F.pow(F.nullif(variance, F.lit(0.0)), F.lit(1.5))
    factor = F.sqrt(size * (size - 1)) / (size - 2)
    return sums.select(
        "feature", "n", "nulls", "mean", variance.alias("variance"),
        F.when(size > 2, F.coalesce(g1, F.lit(0.0)) * factor).alias("skewness"),
    )


