import hashlib
import random

import pytest
from pyspark.sql import functions as F

from foldwright.operators import ordering, splits
from foldwright.operators.columns import TARGET
from foldwright.sources import registry
from foldwright.sources.datasets import dataset


def keyed(spark, n, classes=2):
    return spark.range(n).select(
        F.col("id").cast("string").alias("row_id"), (F.col("id") % classes).cast("string").alias(TARGET))


def test_registry_tiers_and_unknown_name(spark):
    table = registry.registry(spark)
    assert table.count() == 15
    tiers = {r["name"]: r["tier"] for r in table.collect()}
    assert tiers["wine"] == "small" and tiers["adult"] == "medium" and tiers["higgs"] == "large"
    assert tiers["phoneme"] == "small"
    with pytest.raises(KeyError, match="known datasets"):
        registry.get_spec("absent")
    assert registry.names(table, "large", "regression").collect()[0][0] == "year_prediction_msd"
    assert registry.list_datasets(table).filter("local_subset = '-'").count() == 12


def test_folds_are_disjoint_complete_and_balanced(spark):
    df = keyed(spark, 203)
    folds = splits.kfold(df, 42, "classification")
    assert splits.split_violations(folds, df).isEmpty()
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    per = folds.groupBy("fold", TARGET).count().collect()
    assert max(r["count"] for r in per) - min(r["count"] for r in per) <= 1


def test_seeds_differ_and_partitioning_does_not_matter(spark):
    df = keyed(spark, 300)
    a = {r["row_id"]: r["fold"] for r in splits.kfold(df, 42, "classification").collect()}
    b = {r["row_id"]: r["fold"] for r in splits.kfold(df.repartition(7), 42, "classification").collect()}
    c = {r["row_id"]: r["fold"] for r in splits.kfold(df, 43, "classification").collect()}
    assert a == b
    assert a != c


def test_large_table_gets_one_holdout(spark):
    df = keyed(spark, 120_000)
    held = splits.outer_folds(df, 42, "classification", 120_000).filter("fold = 0")
    n = held.count()
    assert abs(n - 24_000) <= 2
    share = held.filter(F.col(TARGET) == "0").count() / n
    assert abs(share - 0.5) < 0.01


def test_bucket_width_does_not_change_ranks(spark):
    df = keyed(spark, 500)
    a = ordering.seeded_rank(df, 1, [TARGET]).select("row_id", "rn")
    b = ordering.seeded_rank(df, 1, [TARGET], expected_rows=10**9).select("row_id", "rn")
    assert a.exceptAll(b).isEmpty()
    assert ordering.prefix_digits(10**12) > ordering.prefix_digits(None)


def test_subset_is_exact_deterministic_and_keeps_rare_classes(spark):
    df = spark.range(1000).select(
        F.col("id").cast("string").alias("row_id"),
        F.when(F.col("id") < 3, "rare").when(F.col("id") < 400, "a").otherwise("b").alias(TARGET))
    one = splits.stratified_subset(df, 97, "classification")
    assert one.count() == 97
    assert one.filter(F.col(TARGET) == "rare").count() >= 1
    assert one.exceptAll(splits.stratified_subset(df.repartition(3), 97, "classification")).isEmpty()


def test_fractions_are_nested_with_a_floor(spark):
    nested = splits.nested_fractions(keyed(spark, 400), [0.01, 0.5, 1.0], 42)
    sizes = {r["fraction"]: r["count"] for r in nested.groupBy("fraction").count().collect()}
    assert sizes == {0.01: 50, 0.5: 200, 1.0: 400}
    small, large = (nested.filter(F.col("fraction") == f).select("row_id") for f in (0.01, 0.5))
    assert small.exceptAll(large).isEmpty()


def test_inner_folds_cover_each_training_set(spark, sf_dir):
    df = dataset(spark, sf_dir, "order_cls3").df.select("row_id", TARGET)
    outer = splits.kfold(df, 42, "classification")
    inner = splits.inner_folds(outer, 3, 42, "classification")
    n = df.count()
    per = {r["outer_fold"]: r["count"] for r in inner.groupBy("outer_fold").count().collect()}
    assert sum(per.values()) == 4 * n
    both = inner.join(outer.select("row_id", "fold"), "row_id")
    assert both.filter("fold = outer_fold").isEmpty()


def plain_quantile(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


@pytest.mark.parametrize("cell_rows", [1_000_000, 40, 3])
def test_quantiles_are_exact_at_every_cell_size(spark, monkeypatch, cell_rows):
    """Ties, hot values, several weight sets and groups; small cells are cut again and again."""
    monkeypatch.setattr(ordering, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(ordering, "LEAST_CELLS", 4)
    rnd = random.Random(cell_rows)
    rows = [("a", rnd.choice([1.0, 1.0, rnd.gauss(0, 1e6), rnd.random()]), rnd.randrange(3)) for _ in range(900)]
    rows += [("b", 7.0, 0)] * 50 + [("c", 2.5, 2)] + [("d", float("nan"), 0), ("d", None, 1), ("a", None, 1)]
    rows += [("e", float(i // 2), i % 3) for i in range(400)] + [("f", s * float("inf"), 0) for s in (1, -1)] + [("f", 0.0, 0)] * 3
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    df = spark.createDataFrame(rows, "g string, v double, fold int").repartition(5)
    weights = {f"w{s}": (F.col("fold") != s).cast("long") for s in range(3)}
    long = df.withColumns(weights)
    got = {(r["g"], r["weight_set"], r["prob"]): r["quantile"] for r in ordering.quantile_table(long, ["g"], "v", list(weights), probs).collect()}
    want = {}
    for g in "abcef":
        for s in range(3):
            values = [v for h, v, fold in rows if h == g and v is not None and fold != s]
            want |= {(g, f"w{s}", p): plain_quantile(values, p) for p in probs if values}
    assert set(got) == set(want)
    for key, q in want.items():
        assert got[key] == pytest.approx(q, rel=1e-12, abs=1e-12) or (q != q and got[key] != got[key]), key


def test_quantiles_of_many_probabilities_and_of_nothing(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), (F.xxhash64("id") % 10_007 / 7).alias("v"), F.lit(1).cast("long").alias("n"))
    values = [r["v"] for r in df.collect()]
    probs = [i / 499 for i in range(500)]
    got = {r["prob_index"]: r["quantile"] for r in ordering.quantile_table(df, ["g"], "v", ["n"], probs).collect()}
    assert [got[i] for i in range(500)] == pytest.approx([plain_quantile(values, p) for p in probs], rel=1e-12)
    assert ordering.quantile_table(df.where("false"), ["g"], "v", ["n"], [0.5]).isEmpty()
    assert ordering.grouped_quantiles(df, [], "v", {"median": 0.5}).first()["median"] == pytest.approx(plain_quantile(values, 0.5), rel=1e-12)


def test_quantiles_shuffle_sketches_and_wanted_cells_only(spark):
    """The rows go through no exchange: what is shuffled has been aggregated."""
    df = spark.range(100_000).select(F.lit("g").alias("g"), F.rand(5).alias("v"), F.lit(1).cast("long").alias("n"))
    table = ordering.quantile_table(df, ["g"], "v", ["n"], [0.5])
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert table.count() == 1 and "Repartition" not in plan and "Window" in plan


def test_hot_values_and_groups_keep_exact_prefix_sums(spark):
    rows = [("g", 1.0, 1)] * 3000 + [("g", float(i), 1) for i in range(2, 200)] + [("h", 5.0, 2)]
    counts = spark.createDataFrame(rows, "g string, v double, n long").groupBy("g", "v").agg(F.sum("n").alias("n"))
    got = {(r["g"], r["v"]): (r["before_n"], r["total_n"]) for r in ordering.prefix_sums(counts, ["g"], "v", ["n"], 5).collect()}
    assert got["g", 1.0] == (0, 3198) and got["g", 2.0] == (3000, 3198) and got["g", 199.0] == (3197, 3198)
    assert got["h", 5.0] == (0, 2)


@pytest.mark.parametrize("digits", [1, 4])
def test_rank_cuts_are_the_places_of_the_ranks(spark, monkeypatch, digits):
    monkeypatch.setattr(ordering, "prefix_digits", lambda rows: digits)
    df = keyed(spark, 500, 3)
    ranked = {(r[TARGET], r["rn"]): r["row_id"] for r in ordering.seeded_rank(df, 9, [TARGET]).collect()}
    ranks = F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 77, 166, 5000)]))
    got = ordering.rank_cuts(df, 9, lambda sizes: sizes.withColumn("rank", ranks), [TARGET]).collect()
    most = {c: max(n for k, n in ranked if k == c) for c in "012"}
    assert len(got) == 15 and all(r["cut"]["key"] == ranked[r[TARGET], min(r["rank"], most[r[TARGET]])] for r in got)


def test_subsets_by_threshold_equal_ranked_subsets(spark):
    df = keyed(spark, 700, 4).unionByName(keyed(spark, 1).withColumn(TARGET, F.lit("rare")).withColumn("row_id", F.lit("r")))
    ranked = ordering.seeded_rank(df, 7).select("row_id", "rn").collect()
    for n in (1, 50, 701, 900):
        got = {r["row_id"] for r in splits.stratified_subset(df, n, "regression", seed=7).collect()}
        assert got == {r["row_id"] for r in ranked if r["rn"] <= n}
    assert splits.stratified_subset(df, 0, "regression", seed=7).count() == 0
    classes = splits.stratified_subset(df, 101, "classification", seed=7).groupBy(TARGET).count().collect()
    assert sum(r["count"] for r in classes) == 101 and {r[TARGET]: r["count"] for r in classes}["rare"] == 1
    sizes = {r["fraction"]: r["count"] for r in splits.nested_fractions(df, [0.1, 0.5, 1.0], 7, minimum=100).groupBy("fraction").count().collect()}
    assert sizes == {0.1: 100, 0.5: 350, 1.0: 701}
    assert splits.nested_fractions(df.limit(0), [0.5], 7).count() == 0 and splits.stratified_subset(df.limit(0), 5, "regression").count() == 0


def test_seeded_rank_sends_no_hash(spark):
    """What is shuffled for the ranks is the rows and their prefix; the ranks are those of the whole hash."""
    rows = [(f"k{i}", i % 3) for i in range(500)]
    ranked = ordering.seeded_rank(spark.createDataFrame(rows, "row_id string, c int"), 7, ["c"])
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    sent = plan[plan.index("RepartitionByExpression"):plan.index("Aggregate")]
    assert "_hash" not in sent and "_bucket" in sent
    by_hash = sorted(rows, key=lambda r: (r[1], hashlib.md5(f"7:{r[0]}".encode()).hexdigest(), r[0]))
    wanted = {key: 1 + i - [x[1] for x in by_hash].index(c) for i, (key, c) in enumerate(by_hash)}
    assert {r["row_id"]: r["rn"] for r in ranked.collect()} == wanted
