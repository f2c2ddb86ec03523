"""Column-type operators: target split, downcasting, label encoding, NaN handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET = "__target__"
_INT_WIDTHS = (("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31), ("bigint", 2**63))


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) column names; booleans count as categorical."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return numeric, [c for c in df.columns if c not in numeric]


def split_target(df: DataFrame, target: str | int = TARGET) -> DataFrame:
    """Name the target ``__target__`` and put it last; by name or by position."""
    name = df.columns[target] if isinstance(target, int) else target
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.col(name).alias(TARGET))


def features_only(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in (TARGET, "row_id")])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Float NaN becomes NULL, so that Spark aggregates skip it."""
    out = []
    for f in df.schema.fields:
        col = F.col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            col = F.when(~F.isnan(col), col).alias(f.name)
        out.append(col)
    return df.select(*out)


def integer_widths(df: DataFrame) -> dict[str, str]:
    """Smallest integer type per integer column, from one min/max aggregate."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    if not cols:
        return {}
    stats = df.agg(
        *[F.min(c).alias(f"lo_{i}") for i, c in enumerate(cols)],
        *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(cols)],
    ).first()
    widths = {}
    for i, c in enumerate(cols):
        lo, hi = stats[f"lo_{i}"], stats[f"hi_{i}"]
        if lo is None:
            widths[c] = "tinyint"
            continue
        widths[c] = next(name for name, limit in _INT_WIDTHS if lo >= -limit and hi < limit)
    return widths


def downcast(df: DataFrame, skip: tuple[str, ...] = ("row_id", TARGET)) -> DataFrame:
    """Floats to float32, integers to the smallest width that holds min..max."""
    widths = integer_widths(df.select(*[c for c in df.columns if c not in skip]))
    out = []
    for f in df.schema.fields:
        col = F.col(f.name)
        if f.name in skip:
            pass
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            col = col.cast("float").alias(f.name)
        elif f.name in widths:
            col = col.cast(widths[f.name]).alias(f.name)
        out.append(col)
    return df.select(*out)


def label_table(df: DataFrame, target: str = TARGET) -> DataFrame:
    """(class, label): 0..K-1 by sorted class value. Classes are few by nature."""
    classes = df.select(F.col(target).alias("class")).distinct()
    order = Window.partitionBy(F.lit(0)).orderBy("class")
    return classes.select("class", (F.dense_rank().over(order) - 1).cast("int").alias("label"))


def encode_target(df: DataFrame, task: str, labels: DataFrame | None = None) -> DataFrame:
    """Replace the target by its integer label, or by a double for regression."""
    if task == "regression":
        return df.withColumn(TARGET, F.col(TARGET).cast("double"))
    labels = label_table(df) if labels is None else labels
    rest = [c for c in df.columns if c != TARGET]
    joined = df.join(F.broadcast(labels), F.col(TARGET) == F.col("class"))
    return joined.select(*rest, F.col("label").alias(TARGET))
