"""Model versions: fitted pipelines as parameter files, served by name."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from foldwright.plans.pipeline import FittedPipeline, load_pipeline

REGISTRY_SCHEMA = (
    "name string, version int, path string, schema_json string, source_run string, params_json string"
)


def best_run(runs: DataFrame, dataset: str, mode: str = "automated") -> DataFrame:
    """Best finished run of a dataset and mode by primary metric (one row, ties to the smaller id)."""
    mine = runs.filter((F.col("dataset") == dataset) & (F.col("mode") == mode) & F.col("primary").isNotNull())
    return mine.orderBy(F.desc("primary"), "run_id").limit(1)


class ModelStore:
    def __init__(self, spark: SparkSession, path: str, prefix: str = "foldwright"):
        self.spark, self.path, self.prefix = spark, path.rstrip("/"), prefix

    def name(self, dataset: str) -> str:
        return f"{self.prefix}-{dataset}"

    def versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(REGISTRY_SCHEMA).parquet(f"{self.path}/registry")
        except AnalysisException:
            return self.spark.createDataFrame([], REGISTRY_SCHEMA)

    def register(
        self, dataset: str, pipeline: FittedPipeline, source_run: str, example: DataFrame, params: dict
    ) -> int:
        """Save a fitted pipeline as the next version, with its input schema and five example rows."""
        name = self.name(dataset)
        last = self.versions().filter(F.col("name") == name).agg(F.max("version")).first()[0] or 0
        version = last + 1
        target = f"{self.path}/{name}/v{version}"
        pipeline.save(self.spark, target)
        example.orderBy("row_id").limit(5).write.mode("overwrite").parquet(f"{target}/example")
        row = [(name, version, target, example.schema.json(), source_run, json.dumps(params, default=str))]
        self.spark.createDataFrame(row, REGISTRY_SCHEMA).write.mode("append").parquet(f"{self.path}/registry")
        return version

    def load(self, dataset: str) -> FittedPipeline:
        """Latest version of the dataset's model."""
        row = (
            self.versions().filter(F.col("name") == self.name(dataset))
            .agg(F.max_by("path", "version").alias("path")).first()
        )
        if row is None or row["path"] is None:
            raise LookupError(f"no registered model for {dataset!r}")
        return load_pipeline(self.spark, row["path"])


def scored_table(pipeline: FittedPipeline, df: DataFrame) -> DataFrame:
    """row_id, prediction code, class (classification) and one probability column per class."""
    out = pipeline.predict(df)
    if pipeline.task == "regression":
        return out.select("row_id", F.col("pred").alias("prediction"))
    names = F.array(*[F.lit(c) for c in pipeline.class_names])
    return out.select(
        "row_id",
        F.col("pred").alias("prediction"),
        F.get(names, F.col("pred")).alias("class"),
        *[F.get("proba", F.lit(i)).alias(f"proba_{i}") for i in range(len(pipeline.class_names))],
    )


def predict_csv(pipeline: FittedPipeline, df: DataFrame, output: str) -> None:
    scored_table(pipeline, df).write.mode("overwrite").option("header", True).csv(output)
