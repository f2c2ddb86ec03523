"""Queries over stored data: caches, CSV sources, split, run and model stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.catalog.base import query
from foldwright.catalog.data import measured_registry
from foldwright.catalog.fixtures import seeded, with_cte
from foldwright.catalog.splits import _deal
from foldwright.operators.columns import TARGET, encode_target
from foldwright.plans import benchmark, experiment, pipeline
from foldwright.session import scratch_path
from foldwright.sources import cache, config, modelstore, runstore, scan, splitstore
from foldwright.sources.datasets import dataset, table
from foldwright.sources.registry import DatasetSpec


@query("source_headerless_csv", """SELECT round(sum(cast(cast(l_quantity AS FLOAT) AS DOUBLE)), 2) AS f0,
  round(sum(cast(cast(l_discount AS FLOAT) AS DOUBLE)), 2) AS f1, round(sum(cast(cast(l_tax AS FLOAT) AS DOUBLE)), 2) AS target, count(*) AS rows FROM lineitem""")
def source_headerless_csv(spark, sf_dir):
    """Line items written as headerless gzip CSV with the target first, read back by position."""
    path = scratch_path(spark, "headerless")
    li = table(spark, sf_dir, "lineitem").select("l_tax", "l_quantity", "l_discount")
    li.write.option("compression", "gzip").csv(path)
    back = scan.read_headerless_csv(spark, path, 3, target=0)
    total = lambda c: F.round(F.sum(F.col(c).cast("double")), 2)
    return back.agg(total("f0").alias("f0"), total("f1").alias("f1"), total(TARGET).alias("target"),
                    F.count(F.lit(1)).alias("rows"))


@query("source_csv_features", "SELECT p_brand, count(*) AS n, cast(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1")
def source_csv_features(spark, sf_dir):
    path = scratch_path(spark, "features")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    parts.write.option("header", True).csv(path)
    back = scan.read_csv_features(spark, path, parts.schema)
    return back.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"))


@query("cache_write_and_load", with_cte("order_cls3") + """SELECT __target__ AS target, count(*) AS n, cast(sum(o_month) AS BIGINT) AS months,
  'tinyint' AS month_type, true AS verified FROM order_cls3 GROUP BY 1""")
def cache_write_and_load(spark, sf_dir):
    """Validate, downcast, write, verify the checksums and load again."""
    folder = scratch_path(spark, "cache")
    df = dataset(spark, sf_dir, "order_cls3").df
    spec = DatasetSpec("order_cls3", "classification", "parquet", "", TARGET, df.count(), 3)
    cache.cache(spark, spec, folder, lambda s: df)
    verified = cache.verify_checksum(spark, "order_cls3", folder)
    loaded, _ = scan.load_dataset(spark, folder, spec)
    return loaded.groupBy(F.col(TARGET).alias("target")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_month").cast("long")).alias("months"),
        F.lit(dict(loaded.dtypes)["o_month"]).alias("month_type"), F.lit(verified).alias("verified"))


@query("cache_load_local_subset", with_cte("event_std") + f"""SELECT count(*) AS n, count(DISTINCT __target__) AS classes, true AS is_subset
  FROM (SELECT * FROM event_std LIMIT 500)""")
def cache_load_local_subset(spark, sf_dir):
    folder = scratch_path(spark, "cache")
    df = dataset(spark, sf_dir, "event_std").df
    spec = DatasetSpec("event_std", "classification", "parquet", "", TARGET, df.count(), 1, local_subset_rows=500)
    cache.cache(spark, spec, folder, lambda s: df)
    loaded, is_subset = scan.load_dataset(spark, folder, spec)
    return loaded.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(TARGET).alias("classes"), F.lit(is_subset).alias("is_subset"))


@query("cache_download_outcomes", """SELECT 'event_std' AS dataset, 'cached' AS status, (SELECT count(*) FROM events) AS rows UNION ALL
  SELECT 'part_reg', 'failed', (SELECT count(*) FROM part)""")
def cache_download_outcomes(spark, sf_dir):
    """Batch caching: one dataset fits its spec, one has the wrong row count and becomes a failed row."""
    sizes = {n: dataset(spark, sf_dir, n).df.count() for n in ("event_std", "part_reg")}
    specs = [DatasetSpec("event_std", "classification", "parquet", "", TARGET, sizes["event_std"], 1),
             DatasetSpec("part_reg", "regression", "parquet", "", TARGET, sizes["part_reg"] + 1, 3)]
    out = cache.download(spark, specs, scratch_path(spark, "cache"), lambda s: dataset(spark, sf_dir, s.name).df, include_large=True)
    counted = spark.createDataFrame(list(sizes.items()), "dataset string, rows long")
    return out.select("dataset", "status").join(counted, "dataset")


@query("split_store_round_trip", with_cte("order_cls3") + f"""SELECT row_id, CASE WHEN (SELECT count(*) FROM order_cls3) < 100000 THEN fold ELSE hold END AS fold
  FROM ({_deal('order_cls3', 42)}) JOIN (SELECT row_id, CASE WHEN row_number() OVER (PARTITION BY __target__ ORDER BY {seeded(42)}, row_id)
    <= floor(count(*) OVER (PARTITION BY __target__) * 0.2e0 + 0.5e0) THEN 0 ELSE -1 END AS hold FROM order_cls3) USING (row_id)""")
def split_store_round_trip(spark, sf_dir):
    """Folds are computed once, stored, and read back from their partition."""
    path = scratch_path(spark, "splits")
    ds = dataset(spark, sf_dir, "order_cls3")
    n = ds.df.count()
    splitstore.get_splits(ds.df, path, "order_cls3", ds.task, 42, n)
    return splitstore.get_splits(ds.df, path, "order_cls3", ds.task, 42, n)


@query("run_store_round_trip", """SELECT 'ds_' || l_returnflag AS dataset, 'linear' AS model, 'automated' AS mode, 42 AS seed,
  round(sum(cast(l_quantity AS BIGINT)) / count(*)::DOUBLE, 6) AS "primary", 500 AS longest FROM lineitem GROUP BY l_returnflag""")
def run_store_round_trip(spark, sf_dir):
    """Runs logged with long parameters, read back as tidy rows."""
    store = runstore.RunStore(spark, scratch_path(spark, "runs"))
    groups = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        (F.sum(F.col("l_quantity").cast("long")) / F.count(F.lit(1))).alias("v"))
    for r in groups.collect():
        name = f"ds_{r['l_returnflag']}"
        store.log_run(name, f"{name}__linear", {"dataset": name, "model": "linear", "benchmark_mode": "automated",
                      "tier": "small", "task": "classification"}, {"seed": 42, "note": "x" * 900},
                      [("roc_auc", r["v"], 0), ("roc_auc_mean", r["v"], None)])
    longest = store.read("run_params").agg(F.max(F.length("value"))).scalar()
    return store.tidy().select("dataset", "model", "mode", "seed", F.round("primary", 6).alias("primary"),
                               longest.alias("longest"))


@query("model_store_register_and_score")
def model_store(spark, sf_dir):
    """Fit on all labelled documents, register, load the latest version, score the same rows."""
    ds = dataset(spark, sf_dir, "doc_quality")
    rows, names, _ = experiment.prepare_rows(ds)
    fitted = pipeline.fit_pipeline(rows, ds.task, "linear", {}, 42, names)
    store = modelstore.ModelStore(spark, scratch_path(spark, "models"))
    store.register("doc_quality", fitted, "run", ds.df.drop(TARGET), {})
    return modelstore.scored_table(store.load("doc_quality"), encode_target(ds.df, ds.task)).select(
        "row_id", "prediction", "class", F.round("proba_0", 6).alias("proba_0"), F.round("proba_1", 6).alias("proba_1"))


@query("model_store_input_example", """SELECT cast(d.doc_id AS VARCHAR) AS row_id, n_chars, lang, source FROM documents d JOIN labels USING (doc_id)
  ORDER BY cast(d.doc_id AS VARCHAR) LIMIT 5""")
def model_store_example(spark, sf_dir):
    return dataset(spark, sf_dir, "doc_quality").df.drop(TARGET).orderBy("row_id").limit(5)


@query("benchmark_run_and_resume", """SELECT 'first' AS sweep, 'completed' AS status, cast(2 AS BIGINT) AS n FROM (SELECT count(*) FROM part)
  UNION ALL SELECT 'first', 'skipped_gated', 2 UNION ALL SELECT 'second', 'skipped_existing', 2 UNION ALL SELECT 'second', 'skipped_gated', 2""")
def benchmark_run_and_resume(spark, sf_dir):
    """A small sweep twice over one store: the second pass finds every run finished."""
    store = runstore.RunStore(spark, scratch_path(spark, "study"))
    sweep = config.sweep_config(spark, "own", [42], ["doc_quality"], ["linear", "lasso"],
                                ["baseline_default", "baseline_expert"])
    reg = measured_registry(spark, sf_dir)
    parts = []
    for name in ("first", "second"):
        out = benchmark.run_benchmark(sweep, reg, lambda n: dataset(spark, sf_dir, n), store, measure_cost=False)
        parts.append(benchmark.outcome_summary(out).select(F.lit(name).alias("sweep"), "status", "n"))
    return parts[0].unionByName(parts[1])
