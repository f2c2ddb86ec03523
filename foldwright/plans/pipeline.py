"""Whole pipelines: preprocessing -> selection -> model, fitted on training rows only."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.models.forest import ForestRegression
from foldwright.models.linear import LinearModel, VectorModel
from foldwright.models.logistic import LogisticModel
from foldwright.models.mlp import MLPModel, Shape
from foldwright.models.neighbours import KNN, KNNModel
from foldwright.models.sgd import SGDModel
from foldwright.models.svm import KernelModel
from foldwright.models.trees import BoosterModel, ExtraTreesModel, tree_from_state
from foldwright.models.zoo import build_model
from foldwright.operators.columns import TARGET, split_columns
from foldwright.operators.preprocess import FittedPreprocessor, NumericParams, Preprocessor
from foldwright.operators.selection import keep_positions, select_features
from foldwright.operators.traits import resolve_auto, traits
from foldwright.session import scratch_path


def params_part(params: Mapping[str, object], prefix: str) -> dict[str, object]:
    return {k[len(prefix) + 1 :]: v for k, v in params.items() if k.startswith(prefix + ".")}


def _json_file(spark: SparkSession, path: str, value: dict) -> None:
    text = json.dumps(value, default=float)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


@dataclass
class FittedPipeline:
    task: str
    prep: FittedPreprocessor
    kept: list[int] | None
    model: object
    class_names: list[str] = field(default_factory=list)
    decisions: dict[str, object] = field(default_factory=dict)

    def prepare(self, df: DataFrame, training: bool = False) -> DataFrame:
        out = self.prep.transform(df, training)
        return out if self.kept is None else keep_positions(out, self.kept)

    def predict(self, df: DataFrame) -> DataFrame:
        """Add pred (label code or number) and, for classifiers, proba."""
        return self.model.predict(self.prepare(df))

    def save(self, spark: SparkSession, path: str) -> None:
        spec = self.prep.spec
        state = self.model.state()
        _json_file(
            spark,
            f"{path}/pipeline.json",
            {
                "task": self.task, "kept": self.kept, "class_names": self.class_names,
                "spec": asdict(spec), "numbers": {c: asdict(p) for c, p in self.prep.numbers.items()},
                "fills": self.prep.fills, "sizes": self.prep.sizes, "slots": self.prep.slots,
                "hot": self.prep.hot, "target_means": self.prep.target_means,
                "has_table": self.prep.table is not None,
                "table_schema": self.prep.table.schema.json() if self.prep.table is not None else None,
                "model": state,
            },
        )
        if self.prep.table is not None:
            self.prep.table.write.mode("overwrite").partitionBy("feature").parquet(f"{path}/categories")
        if state.get("mllib"):
            self.model.model.write().overwrite().save(f"{path}/mllib")
        if isinstance(self.model, KNNModel):
            self.model.train.write.mode("overwrite").parquet(f"{path}/neighbours")

    def size_mb(self, spark: SparkSession) -> float:
        """Bytes of the saved pipeline."""
        path = scratch_path(spark, "model-size")
        self.save(spark, path)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return (files.agg(F.sum("length")).first()[0] or 0) / 1e6


def load_pipeline(spark: SparkSession, path: str) -> FittedPipeline:
    from pyspark.sql import types as T

    s = _read_json(spark, f"{path}/pipeline.json")
    prep = FittedPreprocessor(Preprocessor(**s["spec"]))
    prep.numbers = {c: NumericParams(**p) for c, p in s["numbers"].items()}
    prep.fills, prep.sizes, prep.slots = s["fills"], s["sizes"], s["slots"]
    prep.hot, prep.target_means = s["hot"], s["target_means"]
    if s["has_table"]:
        schema = T.StructType.fromJson(json.loads(s["table_schema"]))
        prep.table = spark.read.schema(schema).parquet(f"{path}/categories")
    return FittedPipeline(s["task"], prep, s["kept"], _model(spark, path, s["model"]), s["class_names"])


def _model(spark: SparkSession, path: str, m: dict):
    kind = m["kind"]
    if kind == "linear":
        return LinearModel(m["coefficients"])
    if kind == "newton_logistic":
        return LogisticModel(m["weights"])
    if kind == "logistic":
        return VectorModel(LogisticRegressionModel.load(f"{path}/mllib"), kind)
    if kind == "random_forest":
        return VectorModel(RandomForestClassificationModel.load(f"{path}/mllib"), kind)
    if kind == "random_forest_regression":
        return ForestRegression(RandomForestRegressionModel.load(f"{path}/mllib"))
    if kind == "sgd":
        return SGDModel(m["task"], np.asarray(m["weights"]))
    if kind == "booster":
        trees = [[tree_from_state(t) for t in r] for r in m["trees"]]
        return BoosterModel(m["task"], m["loss"], m["edges"], m["base"], trees)
    if kind == "extra_trees":
        return ExtraTreesModel(m["task"], m["edges"], [tree_from_state(t) for t in m["trees"]], m["importances"])
    if kind == "kernel":
        return KernelModel(m["task"], tuple(m["spec"]), m["margins"], [tuple(x) for x in m["sigmoids"]])
    if kind == "mlp":
        return MLPModel(m["task"], Shape(*m["shape"]), np.asarray(m["weights"]), np.asarray(m["stats"]),
                        m["mean"], m["std"], m["seed"])
    if kind == "knn":
        spec = KNN(m["task"], m["n_neighbors"], m["weights"], m["classes"])
        return KNNModel(spec, spark.read.parquet(f"{path}/neighbours"))
    raise ValueError(f"no model kind {kind!r}")


def decide(
    features: DataFrame, params: Mapping[str, object]
) -> dict[str, object]:
    """Preprocessing structure: pinned choices from params, the rest from the traits."""
    prep = params_part(params, "prep")
    pinned = {k: str(prep.get(k, "auto")) for k in ("numeric_imputer", "scaler", "cat_encoder")}
    return resolve_auto(traits(features), **pinned).first().asDict(recursive=True)


def fit_pipeline(
    train: DataFrame,
    task: str,
    model: str,
    params: Mapping[str, object],
    seed: int,
    class_names: list[str] | None = None,
    decisions: dict[str, object] | None = None,
) -> FittedPipeline:
    """Fit on training rows (row_id, features..., encoded target).

    ``decisions`` reuses the structure chosen on an outer training set.
    """
    feature_names = [c for c in train.columns if c not in ("row_id", TARGET, "fold")]
    features = train.select(*feature_names)
    classes = len(class_names or []) or 2
    if decisions is None:
        decisions = decide(features, params)
    key = (decisions["numeric_imputer"], decisions["scaler"], decisions["cat_encoder"])
    numeric, categorical = split_columns(features)
    prep = Preprocessor(numeric, categorical, task, *key, seed=seed, classes=classes).fit(train)
    ready = prep.transform(train, training=True).persist()
    select = params_part(params, "select")
    kept = select_features(
        ready, str(select.get("strategy", "none")), task, classes,
        int(float(select.get("percentile", 50))), float(select.get("n_features_fraction", 0.5)), seed,
    )
    data = ready if kept is None else keep_positions(ready, kept)
    try:
        fitted = build_model(model, task, seed, params_part(params, "model"), classes).fit(data)
    finally:
        ready.unpersist()
    return FittedPipeline(task, prep, kept, fitted, class_names or [], decisions)
