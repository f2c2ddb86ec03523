"""Run store: runs, tags, parameters, metrics and search artifacts as parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from foldwright.functions.scalar import truncated
from foldwright.sources.config import RESUME_KEYS

SCHEMAS = {
    "runs": "run_id string, run_name string, status string, dataset string",
    "run_tags": "run_id string, name string, value string, dataset string",
    "run_params": "run_id string, name string, value string, dataset string",
    "run_metrics": "run_id string, name string, value double, step int, dataset string",
    "trials": "run_id string, fold int, trial int, params map<string,string>, value double, state string, dataset string",
    "best_params": "run_id string, fold int, params map<string,string>, dataset string",
    "decisions": "run_id string, param string, value string, dataset string",
    "outcomes": "dataset string, model string, seed int, mode string, status string, detail string",
    "scaling": "dataset string, model string, fraction double, n_rows long, primary double, fit_seconds double, model_size_mb double",
}


class RunStore:
    """Append-only tables below one folder, partitioned by dataset for pruning."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, table: str) -> DataFrame:
        """A table of the store; empty with the right schema before the first write."""
        schema = SCHEMAS[table]
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def append(self, table: str, rows: DataFrame | Sequence[tuple]) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(list(rows), SCHEMAS[table])
        if table in ("run_params",):
            df = df.withColumn("value", truncated(F.col("value")))
        df.write.mode("append").partitionBy("dataset").parquet(f"{self.path}/{table}")

    def log_run(
        self,
        dataset: str,
        run_name: str,
        tags: Mapping[str, object],
        params: Mapping[str, object],
        metrics: Sequence[tuple[str, float, int | None]],
        status: str = "FINISHED",
    ) -> str:
        """Store one run: tags, params (cut to 500 characters), metrics with their fold step.

        The run row is written last, so a run with a row is complete.
        """
        run_id = uuid.uuid4().hex
        self.append("run_tags", [(run_id, k, str(v), dataset) for k, v in tags.items() if v is not None])
        self.append("run_params", [(run_id, k, str(v), dataset) for k, v in params.items()])
        self.append("run_metrics", [(run_id, n, float(v), s, dataset) for n, v, s in metrics])
        self.append("runs", [(run_id, run_name, status, dataset)])
        return run_id

    def tidy(self) -> DataFrame:
        from foldwright.plans.report import tidy_runs

        return tidy_runs(
            self.read("runs").drop("dataset"), self.read("run_tags").drop("dataset"),
            self.read("run_params").drop("dataset"), self.read("run_metrics").drop("dataset"),
        )

    def finished_keys(self) -> DataFrame:
        """Resume keys of finished benchmark runs."""
        wide = self.read("run_tags").filter(F.col("name").isin("dataset", "model", "benchmark_mode")).groupBy(
            "run_id"
        ).pivot("name", ["dataset", "model", "benchmark_mode"]).agg(F.first("value"))
        params = self.read("run_params").groupBy("run_id").pivot(
            "name", ["seed", "budget_profile", "data_variant"]
        ).agg(F.first("value"))
        done = self.read("runs").filter("status = 'FINISHED'").select("run_id")
        return (
            done.join(wide, "run_id").join(params, "run_id")
            .withColumn("seed", F.col("seed").cast("int"))
            .withColumnRenamed("benchmark_mode", "mode")
            .select(*RESUME_KEYS)
        )


def find_runs(runs: DataFrame, tags: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Finished runs whose tags equal all wanted values."""
    hit = None
    for name, value in wanted.items():
        one = (F.col("name") == name) & (F.col("value") == value)
        hit = one if hit is None else hit | one
    full = tags.filter(hit).groupBy("run_id").agg(F.count_distinct("name").alias("_n")).filter(
        F.col("_n") == len(wanted)
    )
    return runs.filter("status = 'FINISHED'").select("run_id").join(full.select("run_id"), "run_id", "left_semi")
