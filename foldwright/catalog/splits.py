"""Queries over folds, holdouts and subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.catalog.base import query
from foldwright.catalog.fixtures import seeded, with_cte
from foldwright.operators import ordering, splits
from foldwright.operators.columns import TARGET
from foldwright.sources.datasets import dataset


def _deal(name: str, seed: int, k: int = 5) -> str:
    """Stratified dealing: rank in class plus the rows of earlier classes."""
    return f"""SELECT row_id, __target__, cast((row_number() OVER (PARTITION BY __target__
      ORDER BY {seeded(seed)}, row_id) - 1 + before) % {k} AS INTEGER) AS fold
      FROM {name} JOIN (SELECT __target__, coalesce(sum(count(*)) OVER (ORDER BY __target__
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {name}
        GROUP BY __target__) c USING (__target__)"""


@query("row_number_by_seeded_hash", with_cte("order_cls3") + f"""SELECT row_id, row_number() OVER
  (PARTITION BY __target__ ORDER BY {seeded(42)}, row_id) AS rn FROM order_cls3""")
def row_number_by_seeded_hash(spark, sf_dir):
    df = dataset(spark, sf_dir, "order_cls3").df
    return ordering.seeded_rank(df, 42, [TARGET]).select("row_id", "rn")


@query("outer_folds_stratified", with_cte("line_cls") + f"SELECT row_id, fold FROM ({_deal('line_cls', 42)})")
def outer_folds_stratified(spark, sf_dir):
    df = dataset(spark, sf_dir, "line_cls").df.select("row_id", TARGET)
    return splits.kfold(df, 42, "classification").select("row_id", "fold")


@query("outer_folds_regression", with_cte("line_reg") + f"""SELECT row_id,
  cast((row_number() OVER (ORDER BY {seeded(42)}, row_id) - 1) % 5 AS INTEGER) AS fold FROM line_reg""")
def outer_folds_regression(spark, sf_dir):
    df = dataset(spark, sf_dir, "line_reg").df.select("row_id")
    return splits.kfold(df, 42, "regression").select("row_id", "fold")


_HOLD = """SELECT row_id, __target__, CASE WHEN row_number() OVER (PARTITION BY __target__ ORDER BY
  {h}, row_id) <= floor(count(*) OVER (PARTITION BY __target__) * 0.2e0 + 0.5e0) THEN 0 ELSE -1 END
  AS fold FROM {n}"""


@query("holdout_stratified", with_cte("event_std") + "SELECT row_id, fold FROM ("
       + _HOLD.format(h=seeded(42), n="event_std") + ")")
def holdout_stratified(spark, sf_dir):
    df = dataset(spark, sf_dir, "event_std").df.select("row_id", TARGET)
    return splits.holdout(df, 42, "classification").select("row_id", "fold")


@query("inner_folds_all_outer", with_cte("order_cls3", extra=f"""outer_f AS ({_deal('order_cls3', 42)}),
  tr AS (SELECT o.row_id, o.__target__, k.outer_fold FROM outer_f o, (SELECT unnest([0,1,2,3,4])
    AS outer_fold) k WHERE k.outer_fold <> o.fold)""") + f"""SELECT row_id, outer_fold,
  cast((row_number() OVER (PARTITION BY outer_fold, __target__ ORDER BY {seeded(1042)}, row_id) - 1)
  % 3 AS INTEGER) AS inner_fold FROM tr""")
def inner_folds_all_outer(spark, sf_dir):
    df = dataset(spark, sf_dir, "order_cls3").df.select("row_id", TARGET)
    outer = splits.kfold(df, 42, "classification")
    return splits.inner_folds(outer, 3, 42, "classification").select(
        "row_id", "outer_fold", "inner_fold")


@query("inner_holdout_split", with_cte("order_cls3", extra=f"""tr AS (SELECT row_id, __target__ FROM
  ({_HOLD.format(h=seeded(42), n='order_cls3')}) WHERE fold = -1)""") + "SELECT row_id, fold FROM ("
       + _HOLD.format(h=seeded(1042), n="tr") + ")")
def inner_holdout_split(spark, sf_dir):
    df = dataset(spark, sf_dir, "order_cls3").df.select("row_id", TARGET)
    train, _ = splits.fold_sides(splits.holdout(df, 42, "classification"), 0)
    return splits.inner_holdout(train.drop("fold"), 42, "classification").select("row_id", "fold")


@query("stratified_subset_events", with_cte("event_std", extra="""c AS (SELECT __target__, count(*) AS n
  FROM event_std GROUP BY 1), s AS (SELECT *, sum(n) OVER () AS total FROM c),
  b AS (SELECT *, greatest(cast(floor(n * 777 / total) AS BIGINT), 1) AS base, (n * 777) % total AS rest
    FROM s), q AS (SELECT __target__, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, __target__)
    <= 777 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b)""") + f"""SELECT row_id, __target__
  FROM (SELECT row_id, __target__, row_number() OVER (PARTITION BY __target__ ORDER BY
  {seeded(20260707)}, row_id) AS rn FROM event_std) JOIN q USING (__target__) WHERE rn <= quota""")
def stratified_subset_events(spark, sf_dir):
    df = dataset(spark, sf_dir, "event_std").df.select("row_id", TARGET)
    return splits.stratified_subset(df, 777, "classification")


@query("uniform_subset_line", with_cte("line_reg") + f"""SELECT row_id FROM line_reg ORDER BY
  {seeded(20260707)}, row_id LIMIT 1000""")
def uniform_subset_line(spark, sf_dir):
    df = dataset(spark, sf_dir, "line_reg").df.select("row_id", TARGET)
    return splits.stratified_subset(df, 1000, "regression").select("row_id")


@query("nested_fractions_line", with_cte("line_reg") + f"""SELECT row_id, fraction FROM (SELECT row_id,
  row_number() OVER (ORDER BY {seeded(42)}, row_id) AS rn, count(*) OVER () AS n FROM line_reg),
  (SELECT unnest([0.01e0, 0.05e0, 0.1e0, 0.33e0, 1e0]) AS fraction) f
  WHERE rn <= greatest(floor(n * fraction), 50)""")
def nested_fractions_line(spark, sf_dir):
    df = dataset(spark, sf_dir, "line_reg").df.select("row_id")
    return splits.nested_fractions(df, splits.SCALING_FRACTIONS, 42).select("row_id", "fraction")


@query("data_fractions_line", with_cte("line_reg") + f"""SELECT fraction, count(*) AS n,
  min(row_id) AS first_key, max(row_id) AS last_key FROM (SELECT row_id,
  row_number() OVER (ORDER BY {seeded(1042)}, row_id) AS rn, count(*) OVER () AS n FROM line_reg),
  (SELECT unnest([0.25e0, 1e0]) AS fraction) f WHERE rn <= greatest(floor(n * fraction), 1)
  GROUP BY fraction""")
def data_fractions_line(spark, sf_dir):
    df = dataset(spark, sf_dir, "line_reg").df.select("row_id")
    return splits.data_fractions(df, 42).groupBy("fraction").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_key"),
        F.max("row_id").alias("last_key"))


@query("fold_join_sides", with_cte("line_cls", extra=f"f AS ({_deal('line_cls', 42)})") + """
  SELECT fold, CASE WHEN fold = k THEN 'test' ELSE 'train' END AS side, k AS test_fold, count(*) AS n,
  cast(sum(cast(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM line_cls JOIN f USING (row_id),
  (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY ALL""")
def fold_join_sides(spark, sf_dir):
    df = dataset(spark, sf_dir, "line_cls").df
    folds = splits.kfold(df.select("row_id", TARGET), 42, "classification")
    joined = splits.join_folds(df.select("row_id", "l_quantity"), folds)
    sums = joined.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    sided = sums.withColumn("test_fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    side = F.when(F.col("fold") == F.col("test_fold"), "test").otherwise("train")
    return sided.select("fold", side.alias("side"), "test_fold", "n", "quantity")


@query("fold_complement_train", with_cte("order_cls3", extra=f"f AS ({_deal('order_cls3', 43)})")
       + "SELECT row_id FROM f EXCEPT ALL SELECT row_id FROM f WHERE fold = 1")
def fold_complement_train(spark, sf_dir):
    df = dataset(spark, sf_dir, "order_cls3").df.select("row_id", TARGET)
    train, _ = splits.fold_sides(splits.kfold(df, 43, "classification"), 1)
    return train.select("row_id")


@query("split_integrity", with_cte("order_cls3") + """SELECT row_id, cast(0 AS BIGINT) AS n_folds
  FROM order_cls3 WHERE cast(row_id AS BIGINT) % 500 = 7 UNION ALL
  SELECT row_id, 2 FROM order_cls3 WHERE cast(row_id AS BIGINT) % 500 = 9""")
def split_integrity(spark, sf_dir):
    """Folds with some keys left out and some doubled on purpose: exactly those are reported."""
    df = dataset(spark, sf_dir, "order_cls3").df.select("row_id", TARGET)
    folds = splits.kfold(df, 42, "classification")
    kind = F.col("row_id").cast("long") % 500
    broken = folds.filter(kind != 7).unionByName(folds.filter(kind == 9))
    return splits.split_violations(broken, df)


@query("child_seeds_per_customer", """SELECT c_custkey, cast(('0x' || substr(md5('42:' || c_custkey), 1, 7))
  AS BIGINT) AS seed FROM customer""")
def child_seeds(spark, sf_dir):
    from foldwright.functions.scalar import child_seed
    from foldwright.sources.datasets import table

    return table(spark, sf_dir, "customer").select(
        "c_custkey", child_seed(42, F.col("c_custkey")).alias("seed"))


@query("subset_sizes_half_even", """SELECT l_suppkey, cast(round_even(count(*) * 0.25e0, 0) AS BIGINT) AS quarter,
  cast(greatest(floor(count(*) * 0.1e0), 50) AS BIGINT) AS tenth FROM lineitem GROUP BY 1""")
def subset_sizes(spark, sf_dir):
    from foldwright.sources.datasets import table

    n = F.count(F.lit(1))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.bround(n * 0.25, 0).cast("long").alias("quarter"),
        F.greatest(F.floor(n * 0.1), F.lit(50)).cast("long").alias("tenth"))
