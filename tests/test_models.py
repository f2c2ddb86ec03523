import threading

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from foldwright.functions.scalar import hash_unit, normal_ppf_sql
from foldwright.models import linear, neighbours
from foldwright.models.logistic import Logistic
from foldwright.models import mlp, sgd, svm, synchronous, trees
from foldwright.models.mlp import MLP
from foldwright.models.sgd import SGD
from foldwright.models.zoo import available_models, build_model, build_quantile_model, is_allowed
from foldwright.operators import selection
from foldwright.operators.columns import TARGET

LIGHT = {
    "random_forest": {"n_estimators": 10, "max_depth": 5},
    "extra_trees": {"n_estimators": 10, "max_depth": 5},
    "hist_gb": {"max_iter": 4, "max_depth": 3, "learning_rate": 0.5},
    "xgboost": {"n_estimators": 4, "max_depth": 3},
    "torch_mlp": {"max_epochs": 15, "hidden_dim": 32, "lr": 0.02},
}


@pytest.fixture(scope="module")
def frames(spark):
    """240 rows, 8 normal features; the first three carry the signal."""
    cols = [F.greatest(hash_unit(F.lit(f"f{j}"), F.col("id")), F.lit(1e-6)).alias(f"u{j}") for j in range(8)]
    x = spark.range(240).select("id", *cols).select(
        F.col("id").cast("string").alias("row_id"),
        F.array(*[F.expr(normal_ppf_sql(f"u{j}")) for j in range(8)]).alias("features"))
    signal = F.get("features", F.lit(0)) + F.get("features", F.lit(1)) + F.get("features", F.lit(2))
    cls = x.withColumn(TARGET, (signal > 0).cast("int")).persist()
    reg = x.withColumn(TARGET, signal + 0.1 * F.get("features", F.lit(3))).persist()
    return cls, reg


@pytest.mark.parametrize("model", available_models("classification", "small"))
def test_classifiers_learn_and_give_probabilities(frames, model):
    cls, _ = frames
    out = build_model(model, "classification", 1, LIGHT.get(model)).fit(cls).predict(cls)
    total = F.aggregate("proba", F.lit(0.0), lambda a, b: a + b)
    r = out.agg(F.avg((F.col("pred") == F.col(TARGET)).cast("double")).alias("acc"),
                F.max(F.abs(total - 1)).alias("off"), F.count("*").alias("n")).first()
    assert r["n"] == 240 and r["acc"] > 0.7 and r["off"] < 1e-9


@pytest.mark.parametrize("model", available_models("regression", "small"))
def test_regressors_are_finite_and_learn(frames, model):
    _, reg = frames
    params = {"alpha": 0.01} if model == "lasso" else LIGHT.get(model)
    out = build_model(model, "regression", 1, params).fit(reg).predict(reg)
    r = out.agg(F.corr("pred", TARGET).alias("r"), F.max(F.abs("pred")).alias("m"), F.count("pred").alias("n")).first()
    assert r["n"] == 240 and np.isfinite(r["m"]) and r["r"] > 0.5


def test_gates():
    assert not is_allowed("svm", "medium") and is_allowed("knn", "medium") and not is_allowed("knn", "large")
    assert "lasso" not in available_models("classification", "small")
    with pytest.raises(ValueError, match="lasso"):
        build_model("lasso", "classification")


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_sgd_weights_do_not_depend_on_the_layout(frames, monkeypatch, task):
    df = frames[0] if task == "classification" else frames[1]
    fit = lambda rows: SGD(task, epochs=2, steps=3, penalty="elasticnet").fit(rows).weights
    few = fit(df.repartition(4))
    assert (few == fit(df.repartition(40))).all() and np.abs(few).max() > 0
    assert not (few == SGD(task, epochs=2, steps=3, penalty="elasticnet", seed=5).fit(df).weights).all()


def test_steps_add_up_to_the_gradient_of_all_rows(frames):
    rows = synchronous.lay_out(frames[0], steps=5, blocks=3)
    w = np.full((1, 9), 0.1)
    of = lambda x, y, block: sgd.contribution("classification", w, x, y)
    whole = synchronous.summed_step(rows, None, of)
    parts = [synchronous.summed_step(rows, k, of) for k in range(5)]
    assert whole[0] == sum(p[0] for p in parts) == frames[0].count()
    assert np.allclose(whole[1], sum(p[1] for p in parts), rtol=1e-12)
    assert synchronous.summed_step(rows, 7, of) == (0.0, None)


def test_packed_steps_give_the_same_sums(frames):
    """The steps of a fit read a row for each run of a mini-batch and block, and add the same numbers in the same order."""
    rows = synchronous.lay_out(frames[0], steps=2, blocks=3)
    cells = synchronous.packed(rows)
    of = lambda x, y, block: np.concatenate([[block * y.sum()], x.T @ y])
    assert cells.count() < rows.count() / 4 and synchronous.row_width(cells) == len(rows.first()["features"])
    for step in (0, 1, None):
        (n, sums), (whole, expected) = synchronous.summed_step(cells, step, of), synchronous.summed_step(rows, step, of)
        assert n == whole and np.array_equal(sums, expected)


def test_chunks_do_not_depend_on_the_batches(frames, monkeypatch):
    table = frames[0].select(TARGET, "features", (F.col(TARGET) * 0 + 3).cast("int").alias("block")).toArrow()
    monkeypatch.setattr(synchronous, "CHUNK_ROWS", 50)
    cut = lambda size: [(b, x.tolist(), y.tolist()) for b, x, y in synchronous._chunks(iter(table.to_batches(max_chunksize=size)))]
    assert cut(7) == cut(1000) and [len(y) for _, _, y in cut(7)][:-1] == [50] * (len(cut(7)) - 1)


def test_sgd_stops_when_the_loss_stands_still(frames):
    data = SGD("classification").lay_out(frames[0])
    seen = []

    class Counted(SGD):
        def epoch(self, *args):
            seen.append(1)
            return super().epoch(*args)

    Counted("classification", epochs=9, steps=2, tol=10.0, patience=2).fit(frames[0])
    assert len(seen) == 2 + 1 and data.columns == [TARGET, "features", "mini_batch", "block"]


def test_mlp_is_repeatable_and_layout_free(frames):
    cls, _ = frames
    a = MLP("classification", hidden_dim=16, max_epochs=3).fit(cls)
    b = MLP("classification", hidden_dim=16, max_epochs=3).fit(cls.repartition(5))
    assert np.array_equal(a.weights, b.weights)


def test_dropout_uncertainty_is_positive_and_repeatable(frames):
    _, reg = frames
    model = MLP("regression", hidden_dim=16, max_epochs=3, dropout=0.2).fit(reg)
    a = {r["row_id"]: (r["mean"], r["std"]) for r in model.predict_uncertainty(reg).collect()}
    b = {r["row_id"]: (r["mean"], r["std"]) for r in model.predict_uncertainty(reg.repartition(3)).collect()}
    assert all(s > 0 for _, s in a.values())
    assert all(abs(a[k][0] - b[k][0]) < 1e-9 for k in a)


def test_dropout_passes_send_rows_once_to_many_tasks(spark, monkeypatch):
    """Repeated and null keys merge, the passes are those of the masks, one by one, and one partition becomes many."""
    rng = np.random.default_rng(3)
    shape = mlp.Shape(4, 1, 8, 2, 0.25, True)
    weights, stats = shape.start(5) + 0.05, shape.stats() + 0.1
    data = [(key, [float(v) for v in rng.normal(size=4)]) for key in ["a", "b", "b", None, None, *map(str, range(40))]]
    df = spark.createDataFrame(data, "row_id string, features array<double>").coalesce(1)
    model = mlp.MLPModel("regression", shape, weights, stats, 2.0, 3.0, 7)
    got = {r["row_id"]: (r["mean"], r["std"]) for r in model.predict_uncertainty(df, 6).collect()}
    hashes = dict((r[0], r[1]) for r in df.select("row_id", F.xxhash64("row_id")).collect())
    want: dict = {}
    for key, x in data:
        for draw in range(6):
            masks = mlp.row_masks(shape, 7, np.array([hashes[key]]), draw)
            value = mlp.forward(shape, shape.unpack(weights), stats, np.array([x]), masks)[0][0, 0]
            want.setdefault(key, []).append(value * 3.0 + 2.0)
    assert got.keys() == want.keys() and all(np.allclose(got[k], (np.mean(v), np.std(v)), atol=1e-12) for k, v in want.items())
    scored, real = [], mlp.with_computed
    monkeypatch.setattr(mlp, "with_computed", lambda rows, *rest, **more: scored.append(rows) or real(rows, *rest, **more))
    model.predict_uncertainty(df, 6)
    assert scored[0].count() == len(data) and scored[0].rdd.getNumPartitions() > 1


def test_quantile_heads_are_ordered(frames):
    _, reg = frames
    low, high = (build_quantile_model(q, 1, {"max_iter": 3, "max_depth": 2, "learning_rate": 0.5, "alpha": 9}).fit(reg) for q in (0.1, 0.9))
    both = low.predict(reg).withColumnRenamed("pred", "lo")
    r = high.predict(both).agg(F.avg((F.col("pred") >= F.col("lo")).cast("double"))).first()[0]
    assert r > 0.95


def test_ridge_and_lasso_equal_closed_forms(frames):
    _, reg = frames
    rows = reg.collect()
    x = np.array([r["features"] for r in rows])
    y = np.array([r[TARGET] for r in rows])
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(8), xc.T @ yc)
    assert np.allclose(linear.Ridge(2.0).fit(reg).coefficients[1:], want, atol=1e-8)
    w = np.array(linear.Lasso(0.3).fit(reg).coefficients[1:])
    grad = xc.T @ (xc @ w - yc) / len(y)
    assert np.all(np.abs(grad[w == 0]) <= 0.3 + 1e-8)
    assert np.allclose(grad[w != 0], -0.3 * np.sign(w[w != 0]), atol=1e-6)


def test_logistic_reaches_the_optimum(frames):
    cls, _ = frames
    fitted = Logistic(C=0.5).fit(cls)
    rows = cls.collect()
    z = np.column_stack([np.ones(240), [r["features"] for r in rows]])
    y = np.array([r[TARGET] for r in rows])
    w = np.array(fitted.weights[0])
    grad = z.T @ (1 / (1 + np.exp(-z @ w)) - y)
    grad[1:] += w[1:] / 0.5
    assert np.abs(grad).max() < 1e-4


def test_neighbour_blocks_match_brute_force(frames):
    cls, _ = frames
    got = neighbours.neighbour_table(cls, cls, 4, block_rows=50).collect()
    rows = sorted(cls.collect(), key=lambda r: r["row_id"])
    x = np.array([r["features"] for r in rows])
    names = [r["row_id"] for r in rows]
    for i in (0, 17, 101, 239):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = [names[j] for j in np.argsort(d, kind="stable")[:4]]
        mine = [r["train_id"] for r in sorted((r for r in got if r["query_id"] == names[i]), key=lambda r: r["rn"])]
        assert mine == want


def test_exact_match_outvotes_under_distance_weights(spark):
    near = spark.createDataFrame([("q", 0.0, 1.0, 1), ("q", 0.5, 0.0, 2), ("q", 0.5, 0.0, 3)], "query_id string, distance double, y double, rn int")
    r = neighbours.vote(near, 3, "distance", "classification").first()
    assert r["pred"] == 1 and r["proba"] == [0.0, 1.0]
    assert neighbours.vote(near, 3, "uniform", "classification").first()["pred"] == 0


@pytest.mark.parametrize("strategy", selection.STRATEGIES)
@pytest.mark.parametrize("task", ["classification", "regression"])
def test_selection_keeps_some_features(frames, strategy, task):
    df = frames[0] if task == "classification" else frames[1]
    kept = selection.select_features(df, strategy, task, seed=3)
    if strategy == "none":
        assert kept is None
        return
    assert 1 <= len(kept) <= 8
    assert set(kept) & {0, 1, 2}


def test_neighbours_copy_a_row_a_few_times_only():
    assert neighbours._blocks(400, 500) == 1 and neighbours._blocks(2_000, 500) == 4
    assert neighbours._blocks(130_000, 500) == 12
    assert neighbours._blocks(800_000, 500) == -(-800_000 // neighbours.LARGEST_BLOCK)


def test_nearest_in_block_equals_brute_force(monkeypatch):
    monkeypatch.setattr(neighbours, "_CELLS", 700)
    monkeypatch.setattr(neighbours, "_HITS", 40)
    rng = np.random.default_rng(1)
    x, z = rng.integers(0, 3, (90, 3)).astype(float), rng.integers(0, 3, (50, 3)).astype(float)
    for k in (1, 7, 200):
        query, row, distance = neighbours._nearest_in_block(x, z, k)
        exact = np.sqrt(((z[:, None] - x[None]) ** 2).sum(axis=2))
        want = np.argsort(exact, axis=1, kind="stable")[:, :k]
        assert (row.reshape(want.shape) == want).all()
        assert (query == np.repeat(np.arange(50), want.shape[1])).all()
        assert (distance.reshape(want.shape) == np.take_along_axis(exact, want, axis=1)).all()


def test_blocks_are_dealt_evenly_and_cut_into_slices(spark, monkeypatch):
    rows = spark.range(3_000).select(F.col("id").cast("string").alias("row_id"), F.array(F.col("id") % 7 / 1.0).alias("features"), F.lit(1.0).alias(TARGET))
    of = lambda x, y, block: np.array([x.sum()])
    sizes = lambda df: [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    whole = synchronous.lay_out(rows, steps=2, blocks=8)
    assert max(sizes(whole)) < 1.3 * 3_000 / 8
    monkeypatch.setattr(synchronous, "SLICE_ROWS", 100)
    cut = synchronous.lay_out(rows, steps=2, blocks=8)
    assert len(sizes(cut)) == 32 and max(sizes(cut)) < 150
    for step in (0, 1, None):
        assert np.allclose(synchronous.summed_step(cut, step, of)[1], synchronous.summed_step(whole, step, of)[1])
        assert synchronous.summed_step(cut, step, of)[0] == synchronous.summed_step(whole, step, of)[0]


def test_kernel_machine_stores_no_mapped_features(spark):
    """While it is fitted, what is stored is the rows, not 256 cosines a row; it is as good as LinearSVC on all of them."""
    features = F.array(*[F.rand(j) * 3 - 1.5 for j in range(3)])
    rows = spark.range(3000).select(F.col("id").cast("string").alias("row_id"), features.alias("features"))
    sign = F.get("features", F.lit(0)) * F.get("features", F.lit(1)) + F.rand(9) * 0.5 > 0.2
    rows = rows.withColumn(TARGET, sign.cast("int")).persist()
    rows.count()
    stored = lambda: sum(i.memSize() + i.diskSize() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo())
    before, most, ended = stored(), [0], threading.Event()

    def watch():
        while not ended.wait(0.05):
            most[0] = max(most[0], stored())

    watching = threading.Thread(target=watch)
    watching.start()
    try:
        fitted = svm.KernelMachine("classification").fit(rows)
    finally:
        ended.set()
        watching.join()
    assert most[0] - before < 1_000_000
    mapped = svm.fourier_features(rows, *fitted.spec).select(F.col(TARGET).cast("double").alias("label"), array_to_vector("features").alias("v"))
    known = LinearSVC(featuresCol="v", regParam=1 / 3000, maxIter=50, standardization=False).fit(mapped)
    z, label = (np.array(part) for part in zip(*[(r["v"].toArray(), r["label"]) for r in mapped.collect()]))

    def cost(w):
        return np.maximum(0, 1 - (2 * label - 1) * (z @ w[1:] + w[0])).mean() + w[1:] @ w[1:] / 6000

    own, theirs = cost(np.array(fitted.margins[0])), cost(np.array([known.intercept, *known.coefficients.toArray()]))
    assert own < theirs * 1.01
    rows.unpersist()


def test_elimination_bins_the_rows_once(frames, monkeypatch):
    """The rounds drop features of rows that were binned once, with the result of binning what is left anew."""
    train = frames[0]
    calls = []
    edges = trees.bin_edges
    monkeypatch.setattr(trees, "bin_edges", lambda *a: calls.append(1) or edges(*a))
    kept = selection.by_elimination(train, "classification", 2, 0, 0.5, trees=4)
    assert len(calls) == 1
    width = len(train.select("features").first()[0])
    anew = list(range(width))
    while len(anew) > width // 2:
        fitted = trees.ExtraTrees("classification", n_estimators=4, max_depth=6, classes=2, seed=0).fit(selection.keep_positions(train, anew))
        drop = set(np.argsort(np.asarray(fitted.importances), kind="stable")[: max(1, int(width * selection.RFE_STEP))].tolist())
        anew = [k for i, k in enumerate(anew) if i not in drop]
    assert kept == anew
