"""Dataset specs: the public study registry, and measured specs over given tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL_BELOW = 10_000
MEDIUM_BELOW = 100_000
TIERS = ("small", "medium", "large")
TASKS = ("classification", "regression")


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    task: str
    kind: str
    location: str
    target: str
    expected_rows: int
    expected_features: int
    description: str = ""
    local_subset_rows: int | None = None
    options: dict[str, str] = field(default_factory=dict)

    @property
    def tier(self) -> str:
        return tier_of(self.expected_rows)


def tier_of(rows: int) -> str:
    if rows < SMALL_BELOW:
        return "small"
    return "medium" if rows < MEDIUM_BELOW else "large"


def tier(rows: Column) -> Column:
    """Size tier of a row count."""
    return (
        F.when(rows < SMALL_BELOW, "small").when(rows < MEDIUM_BELOW, "medium").otherwise("large")
    )


def tier_rank(tier_column: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier_column).cast("int")


# Public datasets of the study with their known sizes.
# name, task, kind, location, target, rows, features, subset rows, description
_PUBLIC = (
    ("breast_cancer", "classification", "bundled", "load_breast_cancer", "", 569, 30, None,
     "Benign or malignant breast masses"),
    ("wine", "classification", "bundled", "load_wine", "", 178, 13, None,
     "Three wine cultivars by chemistry"),
    ("ionosphere", "classification", "openml", "59", "class", 351, 34, None,
     "Good or bad radar returns"),
    ("diabetes", "regression", "bundled", "load_diabetes", "", 442, 10, None,
     "Diabetes progression after a year"),
    ("concrete_strength", "regression", "openml", "44959", "strength", 1030, 8, None,
     "Strength of concrete by mixture"),
    ("energy_efficiency", "regression", "openml", "44960", "heating_load", 768, 8, None,
     "Heating load by building shape"),
    ("phoneme", "classification", "openml", "1489", "Class", 5404, 5, None,
     "Nasal or oral vowels"),
    ("spambase", "classification", "openml", "44", "class", 4601, 57, None,
     "Spam by word frequencies"),
    ("adult", "classification", "openml", "1590", "class", 48842, 14, None,
     "Census income above a threshold"),
    ("california_housing", "regression", "bundled", "fetch_california_housing", "", 20640, 8, None,
     "House values per census block"),
    ("superconductivity", "regression", "openml", "44964", "critical_temp", 21263, 81, None,
     "Critical temperature of materials"),
    ("covertype", "classification", "openml", "1596", "class", 581012, 54, None,
     "Seven forest cover types"),
    ("year_prediction_msd", "regression", "headerless_csv", "YearPredictionMSD.txt", "0",
     515345, 90, 200_000, "Song year by timbre"),
    ("higgs", "classification", "headerless_csv", "HIGGS.csv.gz", "0",
     11_000_000, 28, 1_000_000, "Higgs signal or background"),
    ("susy", "classification", "headerless_csv", "SUSY.csv.gz", "0",
     5_000_000, 18, 1_000_000, "Supersymmetric signal or background"),
)

PUBLIC_SPECS = tuple(
    DatasetSpec(name, task, kind, location, target, rows, features, text, subset)
    for name, task, kind, location, target, rows, features, subset, text in _PUBLIC
)

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("task", T.StringType(), False),
        T.StructField(
            "source",
            T.StructType(
                [
                    T.StructField("kind", T.StringType()),
                    T.StructField("location", T.StringType()),
                    T.StructField("target", T.StringType()),
                    T.StructField("options", T.MapType(T.StringType(), T.StringType())),
                ]
            ),
        ),
        T.StructField("expected_rows", T.LongType(), False),
        T.StructField("expected_features", T.IntegerType(), False),
        T.StructField("local_subset_rows", T.LongType()),
        T.StructField("description", T.StringType()),
    ]
)


def registry(spark: SparkSession, specs=PUBLIC_SPECS) -> DataFrame:
    """The registry as a table, with the derived tier."""
    rows = [
        (
            s.name,
            s.task,
            (s.kind, s.location, s.target, dict(s.options)),
            s.expected_rows,
            s.expected_features,
            s.local_subset_rows,
            s.description,
        )
        for s in specs
    ]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA).withColumn(
        "tier", tier(F.col("expected_rows"))
    )


def get_spec(name: str, specs=PUBLIC_SPECS) -> DatasetSpec:
    for spec in specs:
        if spec.name == name:
            return spec
    known = ", ".join(sorted(s.name for s in specs))
    raise KeyError(f"no dataset {name!r}; known datasets: {known}")


def names(table: DataFrame, tier: str | None = None, task: str | None = None) -> DataFrame:
    """Registry names, optionally of one tier and one task."""
    out = table
    if tier is not None:
        out = out.filter(F.col("tier") == tier)
    if task is not None:
        out = out.filter(F.col("task") == task)
    return out.select("name")


def list_datasets(table: DataFrame) -> DataFrame:
    """Display table of the registry; '-' where a dataset has no local subset."""
    return table.select(
        "name",
        "task",
        "tier",
        F.col("expected_rows").alias("rows"),
        F.col("expected_features").alias("features"),
        F.coalesce(F.col("local_subset_rows").cast("string"), F.lit("-")).alias("local_subset"),
        "description",
    )
