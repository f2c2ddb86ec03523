"""The booster against brute force: best-first order, depth, sums from siblings, layouts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldwright.models import trees
from foldwright.models.trees import Booster, Growth, Tree, Units
from foldwright.operators.columns import TARGET


def _rows(spark, n=600, parts=4):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, (n, 3)).astype(float)
    y = np.where(x[:, 0] > 30, 50.0 + x[:, 1], 0.1 * x[:, 2]) + rng.normal(0, 0.5, n)
    data = [(f"r{i}", [float(v) for v in x[i]], float(y[i])) for i in range(n)]
    return spark.createDataFrame(data, f"row_id string, features array<double>, {TARGET} double").repartition(parts), x, y


def _grown_by_brute_force(x, y, leaves, rate, min_rows):
    """One tree on residuals: always split the leaf whose best cut gains most."""
    def best(rows):
        g, n, found = y[rows].sum(), len(rows), (1e-9, None, None)
        for j in range(x.shape[1]):
            for cut in np.unique(x[rows, j]):
                left = rows[x[rows, j] <= cut]
                m = len(left)
                if min_rows <= m <= n - min_rows:
                    gl = y[left].sum()
                    gain = gl**2 / m + (g - gl) ** 2 / (n - m) - g**2 / n
                    if gain > found[0] + 1e-6:
                        found = (gain, j, cut)
        return found

    parts = [(np.arange(len(y)), *best(np.arange(len(y))))]
    while len(parts) < leaves:
        i = max(range(len(parts)), key=lambda i: parts[i][1] if parts[i][2] is not None else -1)
        rows, _, j, cut = parts[i]
        if j is None:
            break
        sides = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
        parts[i : i + 1] = [(side, *best(side)) for side in sides]
    out = np.empty(len(y))
    for rows, *_ in parts:
        out[rows] = rate * y[rows].mean()
    return out


def test_two_rounds_equal_brute_force(spark):
    df, x, y = _rows(spark)
    model = Booster("regression", rounds=2, learning_rate=0.5, max_leaves=9, min_rows=5).fit(df)
    want = np.full(len(y), y.mean())
    for _ in range(2):
        want += _grown_by_brute_force(x, y - want, 9, 0.5, 5)
    got = {r["row_id"]: r["pred"] for r in model.predict(df).select("row_id", "pred").collect()}
    assert np.allclose([got[f"r{i}"] for i in range(len(y))], want, atol=1e-5)


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_layout_does_not_change_the_model(spark, task):
    df, _, _ = _rows(spark)
    if task == "classification":
        df = df.withColumn(TARGET, (F.col(TARGET) > 10).cast("double"))
    booster = Booster(task, rounds=3, learning_rate=0.3, max_leaves=8, min_rows=5, subsample=0.8, colsample=0.7)
    parts = [df.repartition(n, *by) for n, by in ((3, ["row_id"]), (11, [TARGET]))]
    assert booster.fit(parts[0]).state() == booster.fit(parts[1]).state()


def test_chain_grows_as_deep_as_the_leaves_allow(spark):
    """Each doubling is best cut off at its top, so the tree is a chain, not a balanced one."""
    data = [(f"{i}-{c}", [float(i)], float(4**i)) for i in range(12) for c in range(2)]
    df = spark.createDataFrame(data, f"row_id string, features array<double>, {TARGET} double")
    ((tree,),) = Booster("regression", rounds=1, max_leaves=12, min_rows=1).fit(df).trees
    assert max(tree.depth) > 8 and tree.feature.count(-1) == 12
    ((flat,),) = Booster("regression", rounds=1, max_leaves=12, min_rows=1, max_depth=2).fit(df).trees
    assert max(flat.depth) == 2


def test_wide_steps_take_feature_blocks(spark, monkeypatch):
    df, _, _ = _rows(spark)
    booster = Booster("regression", rounds=2, max_leaves=5, min_rows=5)
    whole = booster.fit(df).state()
    monkeypatch.setattr("foldwright.models.trees._CELL_BUDGET", 1000)
    assert booster.fit(df).state() == whole


def test_order_takes_the_highest_gain_first():
    growth = Growth()
    growth.splits = {0: {"gain": 9.0}, 1: {"gain": 1.0}, 2: {"gain": 5.0}, 3: {"gain": 4.0}}
    growth.tree = Tree()
    growth.tree.split(0, 0, 5, 1.0, 2.0)
    assert growth.order(3) == [0, 2]
    growth.tree.split(2, 0, 7, 3.0, 4.0)
    assert growth.order(4) == [0, 2, 3] and growth.order(99) == [0, 2, 3, 1]
    assert growth.grown(3).value == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_units_keep_sums_within_longs():
    for n in (1, 10**6, 10**12):
        units = Units.of(n, 7.0)
        assert n * 7.0 / units.g <= 2**62 and n / units.h <= 2**62


def test_plans_do_not_grow_with_rounds_or_steps(spark, monkeypatch):
    """A job's plan names every cached table below it; a chain of states or sums fills the driver's memory."""
    sizes = {}
    best_splits = Booster._best_splits

    def noted(self, sums, units):
        sizes[len(sizes)] = len(sums._jdf.queryExecution().toString())
        return best_splits(self, sums, units)

    monkeypatch.setattr(Booster, "_best_splits", noted)
    Booster("regression", rounds=6, max_leaves=12, min_rows=5).fit(_rows(spark)[0])
    assert len(sizes) > 18
    assert max(sizes.values()) < 12 * sizes[0]


def test_states_beyond_the_written_one_are_whole(spark, monkeypatch):
    monkeypatch.setattr("foldwright.models.trees.CHECKPOINT_ROUNDS", 3)
    df, x, y = _rows(spark)
    model = Booster("regression", rounds=8, learning_rate=0.5, max_leaves=4, min_rows=5).fit(df)
    want = np.full(len(y), y.mean())
    for _ in range(8):
        want += _grown_by_brute_force(x, y - want, 4, 0.5, 5)
    got = {r["row_id"]: r["pred"] for r in model.predict(df).select("row_id", "pred").collect()}
    assert np.allclose([got[f"r{i}"] for i in range(len(y))], want, atol=1e-4)


def test_rows_of_a_fit_are_packed_in_blocks(spark):
    """A pass reads a row for each block, not for each row; the blocks hold what the plain rows hold."""
    df, _, _ = _rows(spark)
    edges, blocks = trees.ExtraTrees("regression", max_bins=16).bin(df)
    plain = trees.binned(df, edges).collect()
    try:
        cells = blocks.collect()
    finally:
        blocks.unpersist()
    assert len(cells) < len(plain) / 4
    held = [(t, b.tobytes()) for r in cells for t, b in zip(np.frombuffer(r[TARGET]), np.frombuffer(r["bins"], dtype=np.int16).reshape(len(r[TARGET]) // 8, -1))]
    assert sorted(held) == sorted((r[TARGET], bytes(r["bins"])) for r in plain)
    known = pa.RecordBatch.from_pydict({TARGET: pa.array([np.array([3.0, np.nan]).tobytes()], pa.binary()), "raw": pa.array([np.array([1.0, 2.0]).tobytes()], pa.binary())})
    state = spark.createDataFrame(known.to_pylist(), f"{TARGET} binary, raw binary")
    assert trees._residual_bounds(state).collect()[0]["largest"] == 2.0 and [r[0] for r in trees._targets(state).collect()] == [3.0, None]
