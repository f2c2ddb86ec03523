"""Random forest by MLlib."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.models.arrays import spread
from foldwright.models.linear import VectorModel
from foldwright.operators.columns import TARGET


@dataclass
class RandomForest:
    task: str
    n_estimators: int = 300
    max_depth: int = 12
    min_samples_leaf: int = 1
    max_features: float | None = None
    seed: int = 0
    classes: int = 2

    def fit(self, train: DataFrame):
        subset = "auto" if self.max_features is None else str(float(self.max_features))
        if self.max_features is None and self.task == "regression":
            subset = "all"
        common = dict(
            featuresCol="_v", labelCol="label", numTrees=self.n_estimators, seed=self.seed,
            maxDepth=min(self.max_depth, 30), minInstancesPerNode=self.min_samples_leaf,
            featureSubsetStrategy=subset, maxBins=64, cacheNodeIds=False,
        )
        vectors = spread(train, train.count()).select(
            F.col(TARGET).cast("double").alias("label"), array_to_vector("features").alias("_v")).persist()
        try:
            if self.task == "classification":
                return VectorModel(RandomForestClassifier(**common).fit(vectors), "random_forest")
            return ForestRegression(RandomForestRegressor(**common).fit(vectors))
        finally:
            vectors.unpersist()


@dataclass
class ForestRegression:
    model: object

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(df.withColumn("_v", array_to_vector("features")))
        return scored.select(*df.columns, F.col("prediction").alias("pred"))

    def state(self) -> dict:
        return {"kind": "random_forest_regression", "mllib": True}
