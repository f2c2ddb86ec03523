"""Queries over sources, dataset checks and column operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.catalog.base import query
from foldwright.catalog.fixtures import with_cte
from foldwright.operators import columns, traits, validate
from foldwright.operators.columns import TARGET
from foldwright.sources import cache, registry, scan
from foldwright.sources.datasets import BUILDERS, dataset, table
from foldwright.sources.registry import DatasetSpec

NAMES = ("line_reg", "line_cls", "order_cls3", "event_skew", "event_std", "doc_quality",
         "part_reg", "embed_cls10")
_TIER_SQL = ("CASE WHEN rows < 10000 THEN 'small' WHEN rows < 100000 THEN 'medium' "
             "ELSE 'large' END")
_FEATURES = {"line_reg": 6, "line_cls": 6, "order_cls3": 3, "event_skew": 3, "event_std": 1,
             "doc_quality": 3, "part_reg": 3, "embed_cls10": 64}
MEASURED = "measured AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS name, '{BUILDERS[n][0]}' AS task, count(*) AS rows, "
    f"cast({_FEATURES[n]} AS BIGINT) AS features FROM {n}" for n in NAMES
) + f"), tiers AS (SELECT *, {_TIER_SQL} AS tier FROM measured)"
MEASURED_SQL = with_cte(*NAMES, extra=MEASURED)


def measured_registry(spark, sf_dir) -> DataFrame:
    """Specs measured from the given tables: name, task, rows, features, tier."""
    parts = []
    for name in NAMES:
        ds = dataset(spark, sf_dir, name)
        parts.append(
            ds.df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("name"),
                F.lit(ds.task).alias("task"),
                "rows",
                F.lit(len(ds.features)).cast("long").alias("features"),
            )
        )
    return reduce(DataFrame.unionByName, parts).withColumn("tier", registry.tier(F.col("rows")))


def spec_of(name: str, rows: int, features: int | None = None) -> DatasetSpec:
    return DatasetSpec(name, BUILDERS[name][0], "parquet", name, TARGET, rows,
                       _FEATURES[name] if features is None else features)


@query("registry_measured", MEASURED_SQL + "SELECT name, task, rows, features, tier FROM tiers")
def registry_measured(spark, sf_dir):
    return measured_registry(spark, sf_dir)


@query("registry_names_by_tier_and_task",
       MEASURED_SQL + "SELECT name FROM tiers WHERE tier <> 'large' AND task = 'classification'")
def registry_names(spark, sf_dir):
    table_ = measured_registry(spark, sf_dir)
    keep = [registry.names(table_, t, "classification") for t in ("small", "medium")]
    return keep[0].unionByName(keep[1])


@query("registry_size_tiers", """SELECT tier, count(*) AS n_groups, cast(sum(rows) AS BIGINT) AS rows
  FROM (SELECT CASE WHEN rows < 10000 THEN 'small' WHEN rows < 100000 THEN 'medium' ELSE 'large' END
        AS tier, rows FROM (SELECT l_suppkey, count(*) * 20 AS rows FROM lineitem GROUP BY 1))
  GROUP BY tier""")
def registry_size_tiers(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        (F.count(F.lit(1)) * 20).alias("rows"))
    return per.groupBy(registry.tier(F.col("rows")).alias("tier")).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("rows").alias("rows"))


@query("registry_listing", MEASURED_SQL + """SELECT name, task, tier, rows, features,
  CASE WHEN rows >= 10000 THEN cast(cast(floor(rows / 10) AS BIGINT) AS VARCHAR) ELSE '-' END
  AS local_subset, name || ' table' AS description FROM tiers""")
def registry_listing(spark, sf_dir):
    return registry.list_datasets(
        measured_registry(spark, sf_dir).select(
            "name", "task", "tier", F.col("rows").alias("expected_rows"),
            F.col("features").alias("expected_features"),
            F.when(F.col("rows") >= 10000, F.floor(F.col("rows") / 10)).alias("local_subset_rows"),
            F.concat("name", F.lit(" table")).alias("description")))


@query("dataset_load_split_target", with_cte("line_cls") + """SELECT __target__ AS target,
  count(*) AS n, count(l_tax_n) AS n_tax, cast(sum(cast(l_quantity AS BIGINT)) AS BIGINT) AS quantity
  FROM line_cls GROUP BY 1""")
def dataset_load(spark, sf_dir):
    df = columns.split_target(dataset(spark, sf_dir, "line_cls").df)
    return df.groupBy(F.col(TARGET).alias("target")).agg(
        F.count(F.lit(1)).alias("n"), F.count("l_tax_n").alias("n_tax"),
        F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("batch_row_totals", "SELECT count(*) AS rows FROM events")
def batch_row_totals(spark, sf_dir):
    return scan.batch_sizes(table(spark, sf_dir, "events")).agg(F.sum("rows").alias("rows"))


@query("content_fingerprint_events")
def content_fingerprint(spark, sf_dir):
    return cache.content_fingerprint(table(spark, sf_dir, "events"))


@query("validate_line_cls", with_cte("line_cls") + """SELECT 'line_cls' AS dataset,
  count(*) AS rows, cast(6 AS BIGINT) AS features,
  round(cast(count(*) - count(l_tax_n) AS DOUBLE) / (count(*) * 6), 6) AS missing_fraction,
  count(DISTINCT __target__) AS n_classes,
  ['expected ' || (count(*) + 1) || ' rows, found ' || count(*), 'expected 7 features, found 6'] AS errors, false AS ok FROM line_cls""")
def validate_line_cls(spark, sf_dir):
    df = dataset(spark, sf_dir, "line_cls").df
    report = validate.validate(spec_of("line_cls", df.count() + 1, 7), df)
    return report.withColumn("missing_fraction", F.round("missing_fraction", 6))


_VALID_ONE = """SELECT '{n}' AS dataset, count(*) AS rows, cast({f} AS BIGINT) AS features,
  {k} AS n_classes, '{n}' NOT IN ('line_reg', 'event_std') AS ok FROM {n}"""


@query("validate_all_datasets", with_cte(*NAMES) + " UNION ALL ".join(
    _VALID_ONE.format(n=n, f=_FEATURES[n], k="count(DISTINCT __target__)"
                      if BUILDERS[n][0] == "classification" else "NULL::BIGINT") for n in NAMES)
    + " UNION ALL SELECT 'absent', NULL, NULL, NULL, false")
def validate_all_datasets(spark, sf_dir):
    """Every dataset against its measured row count, with one that cannot be read.

    Two of them are held against a wrong row count and must fail.
    """
    counts = {r["name"]: r["rows"] for r in measured_registry(spark, sf_dir).collect()}
    specs = [spec_of(n, c + (n in ("line_reg", "event_std"))) for n, c in counts.items()]
    specs.append(DatasetSpec("absent", "classification", "parquet", "absent", TARGET, 1, 1))
    report = validate.validate_all(
        spark, specs, lambda s: dataset(spark, sf_dir, s.name).df, include_large=True)
    return report.select("dataset", "rows", "features", "n_classes", "ok")


@query("projection_drop_target", with_cte("part_reg") + "SELECT p_brand, p_type, p_size FROM part_reg")
def projection_drop_target(spark, sf_dir):
    return columns.features_only(dataset(spark, sf_dir, "part_reg").df)


@query("numeric_categorical_partition", with_cte("line_cls") + """
  SELECT 'numeric' AS kind, unnest(['l_discount','l_quantity','l_tax_n','l_extendedprice']) AS column_name,
    (SELECT count(*) FROM line_cls) AS rows
  UNION ALL SELECT 'categorical', unnest(['l_returnflag','l_linestatus']), (SELECT count(*) FROM line_cls)""")
def numeric_categorical_partition(spark, sf_dir):
    ds = dataset(spark, sf_dir, "line_cls")
    kinds = [("numeric", c) for c in ds.numeric] + [("categorical", c) for c in ds.categorical]
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column_name"))
                      for k, c in kinds])
    return ds.df.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(pairs), "rows")


@query("downcast_lineitem", """SELECT l_linenumber AS line, count(*) AS n,
  round(sum(cast(cast(l_discount AS FLOAT) AS DOUBLE)), 3) AS discount,
  max(l_quantity) AS max_quantity, max(l_orderkey) AS max_order, 'tinyint' AS line_type
  FROM lineitem GROUP BY 1""")
def downcast_lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    small = columns.downcast(li)
    return small.groupBy(F.col("l_linenumber").cast("int").alias("line")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.col("l_discount").cast("double")), 3).alias("discount"),
        F.max(F.col("l_quantity").cast("double")).alias("max_quantity"),
        F.max(F.col("l_orderkey").cast("long")).alias("max_order"),
        F.lit(dict(small.dtypes)["l_linenumber"]).alias("line_type"))


@query("label_encode_events", with_cte("event_std") + """SELECT row_id,
  cast(dense_rank() OVER (ORDER BY __target__) - 1 AS INTEGER) AS label FROM event_std""")
def label_encode_events(spark, sf_dir):
    df = columns.encode_target(dataset(spark, sf_dir, "event_std").df, "classification")
    return df.select("row_id", F.col(TARGET).alias("label"))


@query("missing_fraction_line", with_cte("line_reg") + """SELECT round(
  cast(count(*) - count(l_tax_n) AS DOUBLE) / (count(*) * 6), 6) AS missing_fraction FROM line_reg""")
def missing_fraction_line(spark, sf_dir):
    df = columns.features_only(dataset(spark, sf_dir, "line_reg").df)
    return traits.missing_fraction(df).select(
        F.round("missing_fraction", 6).alias("missing_fraction"))


@query("class_counts_orders", with_cte("order_cls3") + """SELECT __target__ AS class, count(*) AS n
  FROM order_cls3 GROUP BY 1""")
def class_counts_orders(spark, sf_dir):
    return dataset(spark, sf_dir, "order_cls3").df.groupBy(F.col(TARGET).alias("class")).agg(
        F.count(F.lit(1)).alias("n"))


@query("skewness_events", with_cte("event_skew") + """SELECT round(skewness(value), 5) AS value,
  round(skewness(value3), 5) AS value3 FROM event_skew""")
def skewness_events(spark, sf_dir):
    t = traits.skewness_table(dataset(spark, sf_dir, "event_skew").df, ["value", "value3"])
    return t.select(F.round("value", 5).alias("value"), F.round("value3", 5).alias("value3"))


@query("max_cardinality_parts", with_cte("part_reg") + """SELECT 'p_brand' AS feature,
  count(DISTINCT p_brand) AS n_distinct FROM part_reg UNION ALL
  SELECT 'p_type', count(DISTINCT p_type) FROM part_reg""")
def max_cardinality_parts(spark, sf_dir):
    return traits.cardinalities(dataset(spark, sf_dir, "part_reg").df, ["p_brand", "p_type"])


def trait_sql(name: str, numeric: list[str], categorical: list[str], features: int) -> str:
    fences = ", ".join(
        f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.75) AS {c}_b" for c in numeric)
    outside = " + ".join(
        f"coalesce(cast({c} < {c}_a - 1.5e0 * ({c}_b - {c}_a) OR {c} > {c}_b + 1.5e0 * "
        f"({c}_b - {c}_a) AS BIGINT), 0)" for c in numeric)
    nulls = " + ".join(f"cast({c} IS NULL AS BIGINT)" for c in [*numeric, *categorical])
    skew = ", ".join(f"abs(coalesce(skewness({c}), 0))" for c in numeric)
    card = ", ".join(f"count(DISTINCT {c})" for c in categorical) or "0"
    return f"""SELECT cast({len(numeric)} AS BIGINT) AS n_numeric,
      cast({len(categorical)} AS BIGINT) AS n_categorical,
      cast(sum({nulls}) AS DOUBLE) / (count(*) * {features}) AS missing_fraction,
      cast(sum({outside}) AS DOUBLE) / (count(*) * {len(numeric)}) AS outlier_fraction,
      greatest({skew}) AS max_abs_skew, cast(greatest({card}) AS BIGINT) AS max_cardinality
      FROM {name}, (SELECT {fences} FROM {name}) f"""


TRAITS = {
    "line_reg": (["l_extendedprice", "l_quantity", "l_discount", "l_tax_n"],
                 ["l_returnflag", "l_linestatus"], 6),
    "event_skew": (["value", "value3"], ["props"], 3),
    "event_std": (["value"], [], 1),
    "doc_quality": (["n_chars"], ["lang", "source"], 3),
    "part_reg": (["p_size"], ["p_brand", "p_type"], 3),
}


def _rounded_traits(df):
    return df.withColumns({c: F.round(c, 5) for c in
                           ("missing_fraction", "outlier_fraction", "max_abs_skew")})


_ROUND_TRAITS = """n_numeric, n_categorical, round(missing_fraction, 5) AS missing_fraction,
  round(outlier_fraction, 5) AS outlier_fraction, round(max_abs_skew, 5) AS max_abs_skew,
  max_cardinality"""


@query("outlier_fraction_documents", """SELECT round(avg(CASE WHEN n_chars < a - 1.5e0 * (b - a)
  OR n_chars > b + 1.5e0 * (b - a) THEN 1e0 ELSE 0e0 END), 6) AS outlier_fraction FROM documents,
  (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM documents) q""")
def outlier_fraction_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("n_chars")
    return traits.traits(docs).select(F.round("outlier_fraction", 6).alias("outlier_fraction"))


def _register_traits(name, spec):
    numeric, categorical, features = spec
    body = trait_sql(name, numeric, categorical, features)

    @query(f"traits_{name}", with_cte(name) + f"SELECT {_ROUND_TRAITS} FROM ({body})")
    def run(spark, sf_dir):
        ds = dataset(spark, sf_dir, name)
        return _rounded_traits(traits.traits(ds.df.select(*ds.features)))

    @query(f"decisions_{name}", with_cte(name) + f"""SELECT {_ROUND_TRAITS},
      'median' AS numeric_imputer, CASE WHEN max_abs_skew > 4 THEN 'quantile'
      WHEN outlier_fraction > 0.05 THEN 'robust' ELSE 'standard' END AS scaler,
      CASE WHEN max_cardinality > 15 THEN 'target' ELSE 'onehot' END AS cat_encoder FROM ({body})""")
    def decide(spark, sf_dir):
        ds = dataset(spark, sf_dir, name)
        rows = traits.resolve_auto(traits.traits(ds.df.select(*ds.features)))
        return _rounded_traits(rows).drop("reasons")


for _name, _spec in TRAITS.items():
    _register_traits(_name, _spec)


@query("decision_params_documents", """WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS a,
    quantile_cont(n_chars, 0.75) AS b FROM documents),
  t AS (SELECT avg(CASE WHEN n_chars < a - 1.5e0 * (b - a) OR n_chars > b + 1.5e0 * (b - a)
    THEN 1e0 ELSE 0e0 END) AS o, skewness(n_chars) AS s FROM documents, q)
  SELECT unnest(['prep.n_numeric', 'prep.n_categorical', 'prep.max_cardinality',
    'prep.numeric_imputer', 'prep.scaler', 'prep.cat_encoder', 'prep.reason.numeric_imputer',
    'prep.reason.scaler', 'prep.reason.cat_encoder']) AS param,
  unnest(['1', '0', '0', 'median', CASE WHEN s > 4 THEN 'quantile' WHEN o > 0.05 THEN 'robust'
    ELSE 'standard' END, 'onehot', 'a median stays put under long tails',
    CASE WHEN s > 4 THEN printf('largest absolute skewness %.1f is above 4.0', s)
      WHEN o > 0.05 THEN printf('share of outliers %.3f is above 0.05', o)
      ELSE 'few outliers and little skewness' END, 'all columns have few categories']) AS value FROM t""")
def decision_params_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("n_chars")
    params = traits.decision_params(traits.resolve_auto(traits.traits(docs)))
    return params.filter(~F.col("param").isin(
        "prep.missing_fraction", "prep.outlier_fraction", "prep.max_abs_skew"))


@query("file_checksums", None)
def file_checksums(spark, sf_dir):
    return cache.checksums(spark, sf_dir)


