import hashlib
import random
import tempfile
import threading
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.catalog import models
from foldwright.models import linear
from foldwright.models.sgd import SGD
from foldwright.operators import splits
from foldwright.operators.columns import TARGET, encode_target
from foldwright.operators.traits import skewness_table
from foldwright.operators.validate import validate, validate_all
from foldwright.plans import audit, benchmark, experiment, objective, pipeline, report, scaling, search
from foldwright.sources import cache, config, modelstore, runstore, scan
from foldwright.sources.datasets import dataset, study_runs, table
from foldwright.sources.registry import DatasetSpec
from foldwright.streaming import batches

TINY = {"n_trials": 2, "timeout_s": 120, "inner_folds": 2}


def folder():
    return tempfile.mkdtemp(prefix="foldwright-test-")


def test_sweep_defaults_and_expert_precedence(spark):
    row = config.sweep_config(spark, "s", [1], ["higgs"], ["xgboost"]).first()
    assert row["modes"] == list(config.MODES) and row["budget_profile"] == "smoke" and not row["full_data"]
    planned = spark.createDataFrame([("higgs", "classification", "xgboost"), ("wine", "classification", "xgboost")],
                                    "dataset string, task string, model string")
    got = {(r["dataset"], r["param"]): r["value"] for r in config.resolve_expert(config.expert_params(spark), planned).collect()}
    assert got["higgs", "model.max_depth"] == "8" and got["wine", "model.max_depth"] == "6"
    assert got["higgs", "model.subsample"] == "0.8"
    with pytest.raises(KeyError):
        config.get_budget("absent", "small")


def test_trials_respect_conditions_and_ranges(spark):
    target = spark.createDataFrame([("d", "torch_mlp", "classification", "small", False)],
                                   "dataset string, model string, task string, tier string, has_categorical boolean")
    trials = search.sample_trials(config.search_space(spark, target), 40, 1).collect()
    assert len(trials) == 40
    for t in trials:
        p = t["params"]
        assert ("select.percentile" in p) == (p["select.strategy"] == "filter")
        assert ("select.n_features_fraction" in p) == (p["select.strategy"] == "rfe")
        assert "prep.cat_encoder" not in p and p["model.max_epochs"] == "100"
        assert 1e-4 <= float(p["model.lr"]) <= 1e-2 and p["model.hidden_dim"] in ("64", "128", "256")


def test_proposals_lean_to_good_values(spark):
    target = spark.createDataFrame([("d", "linear", "regression", "large", False)],
                                   "dataset string, model string, task string, tier string, has_categorical boolean")
    space = config.search_space(spark, target)
    history = search.sample_trials(space, 60, 5).withColumn(
        "value", -F.abs(F.log(F.col("params")["model.alpha"].cast("double")) - F.log(F.lit(1.0))))
    near = search.propose(space, history.select("trial", "params", "value"), 10, 5, 60).select(
        F.avg(F.abs(F.log(F.col("params")["model.alpha"].cast("double"))))).first()[0]
    wide = history.select(F.avg(-F.col("value"))).first()[0]
    assert near < wide


def test_experiment_baseline_repeats_and_gates(spark, sf_dir):
    ds = dataset(spark, sf_dir, "part_reg")
    run = lambda: experiment.run_experiment(ds, "linear", mode="baseline", measure_cost=False).aggregated.withColumnRenamed("metric", "name")
    out = audit.repro_audit(run).first()
    assert out["reproducible"] and out["n_metrics"] > 4
    with pytest.raises(ValueError, match="svm"):
        experiment.run_experiment(dataset(spark, "/root/testdata/sf0.01", "line_reg"), "svm", mode="baseline")
    with pytest.raises(ValueError, match="mode"):
        experiment.run_experiment(ds, "linear", mode="other")


def test_checksums_hold_no_file_whole(spark):
    """A file beyond what the binary reader may hold, as any of 2 GB is, read in pieces; with and without a last line end."""
    rng, path = random.Random(3), Path(folder())
    (path / "a b").mkdir()
    content = {"rows": rng.randbytes(200_000), "ended": b"x\r\n\n", "blank": b"\n", "zeros": bytes(90_000), "a b/in": b"\xff\xc3\n" + rng.randbytes(50_000)}
    for name, data in content.items():
        (path / f"{name}.parquet").write_bytes(data)
    limits = {"spark.sql.sources.binaryFile.maxLength": "1000", "spark.sql.files.maxPartitionBytes": "30000b"}
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        found = {(r["file"], r["length"], r["sha256"]) for r in cache.checksums(spark, str(path)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {(f"{name.split('/')[-1]}.parquet", len(data), hashlib.sha256(data).hexdigest()) for name, data in content.items()}


def test_registered_audit_runs_every_outer_fold(spark, sf_dir, monkeypatch):
    asked = []

    def recorded(ds, model, **options):
        asked.append(options.get("folds"))
        return experiment.Experiment(ds.name, model, 42, "baseline", None, spark.createDataFrame([("roc_auc_mean", 0.5)], "metric string, value double"))

    monkeypatch.setattr(experiment, "run_experiment", recorded)
    assert models.audit_repeated_run(spark, sf_dir).first()["reproducible"]
    assert asked == [None, None]


def test_search_stores_full_parameters(spark, sf_dir):
    store = runstore.RunStore(spark, folder())
    e = experiment.run_experiment(
        dataset(spark, sf_dir, "line_cls"), "linear", mode="automated", budget=TINY, store=store,
        extra_tags={"benchmark_mode": "automated"}, measure_cost=False, folds=[0])
    assert {k.split(".")[0] for k in e.best_params[0]} == {"prep", "select", "model"}
    auc = e.aggregated.filter("metric = 'roc_auc_mean'").first()["value"]
    assert auc > 0.9
    assert store.read("trials").count() == 2
    tidy = store.tidy().first()
    assert abs(tidy["primary"] - auc) < 1e-12
    best = modelstore.best_run(store.tidy(), "line_cls").first()
    assert best["run_id"] == e.run_id


def test_benchmark_resumes_and_survives_failures(spark, sf_dir):
    store = runstore.RunStore(spark, folder())
    reg = spark.createDataFrame([("part_reg", "regression", "small"), ("broken", "regression", "small")],
                                "name string, task string, tier string")
    sweep = config.sweep_config(spark, "s", [1], ["part_reg", "broken"], ["linear"], ["baseline_default"])

    def load(name):
        if name == "broken":
            raise OSError("cannot read")
        return dataset(spark, sf_dir, name)

    first = {r["dataset"]: r["status"] for r in benchmark.run_benchmark(sweep, reg, load, store, measure_cost=False).collect()}
    assert first == {"part_reg": "completed", "broken": "failed"}
    second = {r["dataset"]: r["status"] for r in benchmark.run_benchmark(sweep, reg, load, store, measure_cost=False).collect()}
    assert second == {"part_reg": "skipped_existing", "broken": "failed"}


def test_benchmark_resumes_subset_runs(spark, sf_dir):
    store = runstore.RunStore(spark, folder())
    reg = spark.createDataFrame([("part_reg", "regression", "small", 100)], "name string, task string, tier string, local_subset_rows long")
    asked = []

    def load(name, full):
        asked.append(full)
        return replace(dataset(spark, sf_dir, name), is_subset=not full)

    def statuses(full):
        sweep = config.sweep_config(spark, "s", [1], ["part_reg"], ["linear"], ["baseline_default"], full_data=full)
        return [r["status"] for r in benchmark.run_benchmark(sweep, reg, load, store, measure_cost=False).collect()]

    assert statuses(False) == ["completed"] and statuses(False) == ["skipped_existing"]
    assert statuses(True) == ["completed"] and statuses(True) == ["skipped_existing"]
    assert asked == [False, True]


def test_scaling_rows_rise(spark, sf_dir):
    out = scaling.scaling_study(dataset(spark, sf_dir, "part_reg"), ["linear"], [0.4, 1.0]).collect()
    assert [r["n_rows"] for r in out] == [64, 160]


@pytest.mark.parametrize("model,params", [("linear", {}), ("knn", {}), ("random_forest", {"model.n_estimators": 5}),
                                          ("hist_gb", {"model.max_iter": 2}), ("svm", {}), ("extra_trees", {"model.n_estimators": 3}),
                                          ("sgd_linear", {}), ("torch_mlp", {"model.max_epochs": 2})])
def test_saved_pipelines_predict_the_same(spark, sf_dir, model, params):
    ds = dataset(spark, sf_dir, "doc_quality")
    rows, names, _ = experiment.prepare_rows(ds)
    fitted = pipeline.fit_pipeline(rows, ds.task, model, params, 1, names)
    store = modelstore.ModelStore(spark, folder())
    assert store.register("doc_quality", fitted, "r", ds.df, {}) == 1
    again = store.load("doc_quality")
    a, b = (modelstore.scored_table(p, rows) for p in (fitted, again))
    assert a.columns == ["row_id", "prediction", "class", "proba_0", "proba_1"]
    both = a.join(b.select("row_id", F.col("proba_1").alias("other")), "row_id")
    assert both.agg(F.max(F.abs(F.col("proba_1") - F.col("other")))).first()[0] < 1e-12
    with pytest.raises(LookupError):
        store.load("absent")


def test_reports_on_full_thin_and_empty_runs(spark):
    runs = study_runs(spark, "/root/testdata/sf0.001")
    tables = report.study_report(runs)
    assert {"leaderboard", "comparisons", "ranking", "efficiency", "seed_variance"} <= set(tables)
    text = report.markdown({k: tables[k] for k in ("header", "leaderboard", "ranking")})
    assert "leaderboard" in text
    thin = report.study_report(runs.filter("dataset = 'ds_AF' AND model = 'linear' AND seed = 42"))
    few = thin["ranking_test"].first()
    assert few["p_value"] is None and few["note"]
    empty = report.study_report(runs.filter("1 = 0"))
    assert list(empty) == ["header", "note"]


def test_validation_errors(spark):
    spec = DatasetSpec("d", "classification", "parquet", "", TARGET, 3, 2)
    df = spark.createDataFrame([("1", 1.0, "a"), ("2", None, None)], f"row_id string, x double, {TARGET} string")
    r = validate(spec, df).first()
    assert not r["ok"] and len(r["errors"]) == 4 and r["missing_fraction"] == 0.5
    out = validate_all(spark, [spec], lambda s: 1 / 0).first()
    assert not out["ok"] and "division" in out["errors"][0]


def test_cache_refuses_bad_data_and_checks_bytes(spark, sf_dir):
    df = dataset(spark, sf_dir, "part_reg").df
    where = folder()
    good = DatasetSpec("part_reg", "regression", "parquet", "", TARGET, df.count(), 3)
    cache.cache(spark, good, where, lambda s: df)
    assert cache.verify_checksum(spark, "part_reg", where)
    assert not cache.verify_checksum(spark, "absent", where)
    bad = DatasetSpec("bad", "regression", "parquet", "", TARGET, 1, 3)
    with pytest.raises(ValueError, match="expected 1 rows"):
        cache.cache(spark, bad, where, lambda s: df)
    a = cache.content_fingerprint(df).first()
    assert a == cache.content_fingerprint(df.repartition(5)).first()


def test_batches_cover_every_row_once(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    assert scan.batch_sizes(events).agg(F.sum("rows")).first()[0] == events.count()


def parts_of(df, n):
    path = folder()
    df.repartition(n).write.mode("overwrite").parquet(path)
    return path


def test_streamed_traits_equal_batch_traits(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("value")
    stream = batches.stream_batches(spark, parts_of(events, 4) + "/*.parquet", events.schema)
    got = batches.incremental_traits(stream, ["value"]).first()
    want = events.agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")).first()
    skew = skewness_table(events, ["value"]).first()["value"]
    assert got["n"] == want["n"] and abs(got["mean"] - want["m"]) < 1e-9
    assert abs(got["variance"] / want["v"] - 1) < 1e-9 and abs(got["skewness"] / skew - 1) < 1e-9


def test_streamed_training_uses_every_batch(spark, sf_dir):
    rows = encode_target(dataset(spark, sf_dir, "line_cls").df, "classification").select(
        "row_id", F.col(TARGET).cast("double").alias(TARGET),
        F.array(F.col("l_discount") * 10 - 0.5, F.col("l_quantity") / 50 - 0.5, (F.col("l_returnflag") == "R").cast("double")).alias("features"))
    stream = batches.stream_batches(spark, parts_of(rows, 3) + "/*.parquet", rows.schema)
    path = folder()
    model = batches.partial_fit_stream(stream, SGD("classification"), path)
    assert spark.read.parquet(path).select("batch_id").distinct().count() == 3
    acc = model.predict(rows).agg(F.avg((F.col("pred") == F.col(TARGET)).cast("double"))).first()[0]
    assert acc > 0.8


def test_streamed_training_goes_on_after_a_restart(spark, sf_dir):
    rows = encode_target(dataset(spark, sf_dir, "line_cls").df, "classification").select(
        "row_id", F.col(TARGET).cast("double").alias(TARGET), F.array(F.col("l_discount") * 10 - 0.5).alias("features"))
    source, path, checkpoint = folder(), folder(), folder()
    part = lambda k: rows.where(F.pmod(F.xxhash64("row_id"), F.lit(3)) == k).coalesce(1)
    train = lambda: batches.partial_fit_stream(
        batches.stream_batches(spark, source + "/*.parquet", rows.schema), SGD("classification"), path, checkpoint)
    part(0).write.mode("append").parquet(source)
    first = train()
    rows.limit(0).coalesce(1).write.mode("append").parquet(source)
    assert np.allclose(train().weights, first.weights)
    part(1).write.mode("append").parquet(source)
    second = train()
    assert not np.allclose(second.weights, first.weights)
    steps = {r["batch_id"]: r["steps"] for r in spark.read.parquet(path).collect()}
    assert len(steps) == 2 and steps[max(steps)] > steps[min(steps)]


def test_large_tier_rungs_and_stop_rules(spark, sf_dir):
    rows = encode_target(dataset(spark, sf_dir, "line_cls").df, "classification").withColumn("fold", F.lit(-1))
    _, pairs, kind = experiment._rungs(rows, "classification", 42, 1)
    n = rows.count()
    sizes = [(a.count(), b.count()) for a, b in pairs]
    assert kind == "last" and sizes[1][0] + sizes[1][1] == n and sizes[0][1] == sizes[1][1]
    assert sizes[0][0] == sizes[1][0] // 4
    reports = [(t, step, v + 0.1 * step) for t, v in enumerate([0.1, 0.2, 0.3, 0.4, 0.05, 0.35]) for step in range(2)]
    assert experiment.stopped_trials(spark, reports, 0, "mean") == set()
    assert experiment.stopped_trials(spark, reports, 1, "mean") == {4}  # below the median of the four before it
    assert experiment.stopped_trials(spark, reports, 0, "last") == {0, 1, 2, 4, 5} and experiment.stopped_trials(spark, reports, 1, "last") == set()


def one_by_one(pairs, ds, model, base, trials, names):
    out = {}
    for step, (part, validation) in enumerate(pairs):
        for trial, params in trials:
            chosen = {**base, **pipeline.params_part(params, "prep")}
            out[trial, step] = experiment._score(pipeline.fit_pipeline(part, ds.task, model, params, 1, names, chosen), validation)
    return out


@pytest.mark.parametrize(("name", "model", "choices"), [
    ("part_reg", "linear", [{"model.alpha": 0.1}, {"model.alpha": 500.0}, {"model.alpha": 3.0, "prep.scaler": "robust"}, {"model.alpha": 3.0, "select.strategy": "filter"}]),
    ("part_reg", "lasso", [{"model.alpha": 0.1}, {"model.alpha": 20.0}]),
    ("doc_quality", "knn", [{"model.n_neighbors": 3}, {"model.n_neighbors": 9, "model.weights": "distance"}]),
    ("doc_quality", "hist_gb", [{"model.max_iter": 2, "model.max_depth": 3}, {"model.max_iter": 4, "model.max_depth": 3}, {"model.max_iter": 2, "model.max_depth": 2}]),
])
def test_batched_scores_equal_trial_by_trial(spark, sf_dir, name, model, choices):
    ds = dataset(spark, sf_dir, name)
    rows, names, _ = experiment.prepare_rows(ds)
    folded = splits.kfold(rows, 3, ds.task, 2).persist()
    pairs = [splits.fold_sides(folded, i) for i in range(2)]
    base = {"numeric_imputer": "mean", "scaler": "standard", "cat_encoder": "onehot"}
    trials = list(enumerate(choices))
    batched = objective.Objective(pairs, ds.task, model, 1, names, base)
    got = {(t, step): score for step in range(2) for t, score in batched.scores(step, trials).items()}
    batched.close()
    assert got == pytest.approx(one_by_one(pairs, ds, model, base, trials, names), rel=1e-8)


def test_labels_are_not_sent_through_the_driver(spark, tmp_path):
    spark.createDataFrame([(i, "x", "en", "web", 5) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    df = dataset(spark, str(tmp_path), "doc_quality").df
    assert df.count() == 3
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_preparations_of_a_batch_are_judged_together():
    """Trials with different preparations do not wait for each other."""
    both = threading.Barrier(2, timeout=20)

    class Waiting(objective.Objective):
        def _group_scores(self, step, key, selections):
            both.wait()
            return {trial: 1.0 for members in selections.values() for trial, _ in members}, []

    waiting = Waiting([], "regression", "linear", 0, [], {"numeric_imputer": "mean", "scaler": "standard", "cat_encoder": "onehot"})
    assert waiting.scores(0, [(0, {"prep.scaler": "standard"}), (1, {"prep.scaler": "robust"}), (2, {})]) == {0: 1.0, 1: 1.0, 2: 1.0}


def test_model_queries_keep_no_second_copy_of_the_rows(spark, sf_dir):
    """What a model reads once is not stored for it."""
    levels = []

    class Watched(linear.Ridge):
        def fit(self, train):
            levels.append(train.storageLevel)
            return super().fit(train)

    assert models._score(spark, sf_dir, "part_reg", "linear", {}, Watched()).count() == 4
    assert not levels[0].useMemory and not levels[0].useDisk
