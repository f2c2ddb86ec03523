import pytest
from pyspark.sql import functions as F

from foldwright.operators import metrics, stats


def preds(spark, rows):
    return spark.createDataFrame([("r", *r) for r in rows], "run string, y int, pred int, proba array<double>")


def test_calibration_extremes(spark):
    perfect = preds(spark, [(0, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])])
    assert metrics.expected_calibration_error(perfect, ["run"]).first()["ece"] == 0
    assert metrics.brier_score(perfect, ["run"]).first()["brier"] == 0
    wrong = preds(spark, [(1, 0, [0.95, 0.05]), (0, 1, [0.05, 0.95])])
    assert metrics.expected_calibration_error(wrong, ["run"]).first()["ece"] > 0.9
    assert metrics.brier_score(wrong, ["run"]).first()["brier"] > 1.5


def test_confidence_bins_are_open_below(spark):
    edges = spark.createDataFrame([(i / 15, i) for i in range(16)], "c double, i int")
    got = {r["i"]: r["b"] for r in edges.select("i", metrics.confidence_bin(F.col("c")).alias("b")).collect()}
    assert got.pop(0) is None
    assert got == {i: i for i in range(1, 16)}


def test_auc_with_ties(spark):
    rows = [(1, 1, [0.2, 0.8]), (0, 0, [0.2, 0.8]), (1, 0, [0.6, 0.4]), (0, 0, [0.9, 0.1])]
    assert abs(metrics.roc_auc(preds(spark, rows), ["run"]).first()["roc_auc"] - 0.625) < 1e-12


def test_absent_classes_and_constant_target(spark):
    out = metrics.class_metrics(preds(spark, [(0, 0, [1.0, 0.0]), (0, 1, [0.4, 0.6])]), ["run"]).first()
    assert out["accuracy"] == 0.5 and out["balanced_accuracy"] == 0.5
    assert abs(out["f1_macro"] - (2 / 3 + 0) / 2) < 1e-12
    flat = spark.createDataFrame([("r", 2.0, 2.0), ("r", 2.0, 3.0)], "run string, y double, pred double")
    assert metrics.regression_metrics(flat, ["run"]).first()["r2"] == 0.0


def test_intervals(spark):
    df = spark.createDataFrame([("r", 1.0, 0.0, 2.0), ("r", 5.0, 0.0, 5.0), ("r", 9.0, 0.0, 1.0)],
                               "run string, y double, lower double, upper double")
    out = metrics.interval_metrics(df, ["run"]).first()
    assert abs(out["picp_80"] - 2 / 3) < 1e-12
    z = metrics.gaussian_interval(spark.createDataFrame([(0.0, 1.0)], "mean double, std double")).first()
    assert abs(z["upper"] - 1.2815515655446004) < 1e-9


def pairs(spark, a, b):
    return spark.createDataFrame([("c", float(x), float(y)) for x, y in zip(a, b)], "comparison string, a double, b double")


def test_shift_is_significant(spark):
    base = [i * 0.37 % 1 for i in range(20)]
    r = stats.paired_wilcoxon(pairs(spark, [x + 0.5 + i * 1e-4 for i, x in enumerate(base)], base), ["comparison"]).first()
    assert r["significant"] and abs(r["median_delta"] - 0.5) < 0.01 and abs(r["effect_size"] - 1) < 1e-12
    assert abs(r["p_value"] - 2 / 2**20) < 1e-15


def test_identical_scores(spark):
    r = stats.paired_wilcoxon(pairs(spark, [1, 2, 3], [1, 2, 3]), ["comparison"]).first()
    assert (r["p_value"], r["effect_size"], r["median_delta"]) == (1.0, 0.0, 0.0)


def test_exact_p_of_five_pairs(spark):
    r = stats.paired_wilcoxon(pairs(spark, [1, 2, 3, 4, -5], [0] * 5), ["comparison"]).first()
    # Rank sums 10 and 5: P(W <= 5) = 10/32 in each tail.
    assert abs(r["p_value"] - 0.625) < 1e-12


def test_too_few_pairs_give_a_note(spark):
    r = stats.paired_wilcoxon(pairs(spark, [1, 2], [0, 0]), ["comparison"]).first()
    assert r["p_value"] is None and r["note"]


def test_win_tie_loss(spark):
    r = stats.win_tie_loss(pairs(spark, [1, 2, 3, 4], [0.5, 2, 3.5, 3]), ["comparison"]).first()
    assert (r["win"], r["tie"], r["loss"]) == (2, 1, 1)


def scores(spark, k=3, blocks=12):
    rows = [(str(b), chr(97 + t), b * 0.1 + (k - t)) for b in range(blocks) for t in range(k)]
    return spark.createDataFrame(rows, "block string, mode string, score double")


@pytest.mark.parametrize("k,blocks,expected", [(3, 12, 6.14421235e-06), (4, 4, 0.00738316), (5, 6, 7.98747606e-05)])
def test_friedman_tail(spark, k, blocks, expected):
    # chi2 is blocks * (k - 1); e.g. k = 5: exp(-12) * (1 + 12) for 24 at 4 degrees of freedom.
    r = stats.friedman(scores(spark, k, blocks), ["block"], "mode", "score").first()
    assert r["blocks"] == blocks and abs(r["chi2"] - blocks * (k - 1)) < 1e-9
    assert abs(r["p_value"] / expected - 1) < 1e-5


def test_friedman_needs_three_blocks(spark):
    r = stats.friedman(scores(spark, 3, 2), ["block"], "mode", "score").first()
    assert r["p_value"] is None and r["note"]


def test_average_ranks_and_posthoc(spark):
    ranks = stats.average_ranks(stats.block_ranks(scores(spark), ["block"], "mode", "score"), "mode")
    assert {r["mode"]: r["average_rank"] for r in ranks.collect()} == {"a": 1.0, "b": 2.0, "c": 3.0}
    p = {(r["a"], r["b"]): r["p_value"] for r in stats.nemenyi(scores(spark), ["block"], "mode", "score", 3).collect()}
    assert p["a", "c"] < 0.001 and 0.03 < p["a", "b"] < 0.05
