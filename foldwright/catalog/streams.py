"""Queries over Structured Streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.catalog.base import query
from foldwright.models.sgd import SGD
from foldwright.operators.columns import TARGET
from foldwright.session import scratch_path
from foldwright.sources.datasets import table
from foldwright.streaming import batches


def _stream(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    return batches.stream_batches(spark, f"{sf_dir}/{name}*.parquet", schema)


@query("stream_batch_totals", "SELECT count(*) AS rows FROM events")
def stream_batch_totals(spark, sf_dir):
    return batches.batch_totals(_stream(spark, sf_dir, "events")).agg(F.sum("rows").alias("rows"))


@query("stream_incremental_traits", """SELECT 'value' AS feature, count(value) AS n, count(*) - count(value) AS nulls, round(avg(value), 5) AS mean,
  round(var_pop(value), 4) AS variance, round(skewness(value), 5) AS skewness FROM events
  UNION ALL SELECT 'gap', count(g), count(*) - count(g), round(avg(g), 5), round(var_pop(g), 4), round(skewness(g), 5)
  FROM (SELECT CASE WHEN user_id % 7 <> 0 THEN value * 2 + event_id % 5 END AS g FROM events)""")
def stream_incremental_traits(spark, sf_dir):
    gap = F.when(F.col("user_id") % 7 != 0, F.col("value") * 2 + F.col("event_id") % 5)
    stream = _stream(spark, sf_dir, "events").select("value", gap.alias("gap"))
    out = batches.incremental_traits(stream, ["value", "gap"])
    return out.select("feature", "n", "nulls", F.round("mean", 5).alias("mean"),
                      F.round("variance", 4).alias("variance"), F.round("skewness", 5).alias("skewness"))


@query("stream_scored_rows", """SELECT event_id, round(0.5 + value * 0.25, 6) AS pred FROM events""")
def stream_scored_rows(spark, sf_dir):
    from foldwright.models.linear import LinearModel

    model = LinearModel([0.5, 0.25])
    stream = _stream(spark, sf_dir, "events").select("event_id", F.array("value").alias("features"))
    out = scratch_path(spark, "scored")
    batches.score_stream(stream, lambda s: model.predict(s).select("event_id", F.round("pred", 6).alias("pred")),
                         out, scratch_path(spark, "scored-checkpoint"))
    return spark.read.parquet(out)


@query("stream_partial_fit")
def stream_partial_fit(spark, sf_dir):
    """Out-of-core SGD on line items; reports weights and accuracy over all rows."""
    stream = _stream(spark, sf_dir, "lineitem")
    features = F.array(F.col("l_discount") * 10 - 0.5, F.col("l_quantity") / 50 - 0.5)
    label = (F.col("l_discount") * 10 + F.col("l_quantity") / 50 > 1).cast("double")
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    rows = lambda df: df.select(key.alias("row_id"), label.alias(TARGET), features.alias("features"))
    model = batches.partial_fit_stream(rows(stream), SGD("classification"))
    scored = model.predict(rows(table(spark, sf_dir, "lineitem")))
    return scored.agg(F.count(F.lit(1)).alias("rows"),
                      F.avg((F.col("pred") == F.col(TARGET)).cast("double")).alias("accuracy"))
