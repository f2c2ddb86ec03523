"""Helpers shared by the operators: readers, row identity and bounded broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: str = "text") -> Column:
    """Identity of a text: 64-bit hash, null for a null text."""
    return F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text), F.octet_length(F.col(text))))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    test = F.lit(True)
    for key in keys:
        test = test & left[key].eqNullSafe(right[key])
    return test


def no_nulls_first(key: str) -> list[Column]:
    """Order of a nullable key: smallest first, null last."""
    return [F.col(key).isNull().alias(f"{key}_is_null"), F.col(key).alias(key)]


#: A filter is a table of at most so many 64-bit words, so that its broadcast has a bound of a few MB.
FILTER_WORDS = 1 << 18


def _spot(key: Column) -> Column:
    return F.pmod(key, F.lit(FILTER_WORDS)).cast("int")


def _bit(key: Column) -> Column:
    return F.pmod(F.shiftright(key, 32), F.lit(64)).cast("int")


def key_filter(keys: DataFrame) -> DataFrame:
    """A bit set of bounded size of the long column ``key``, as a table (spot, bits)."""
    rows = keys.select(_spot(F.col("key")).alias("spot"), _bit(F.col("key")).alias("bit"))
    return rows.groupBy("spot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def with_maybe(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """rows with the column __maybe: false only if key is not among key_filter's keys. Nothing is shuffled."""
    marked = rows.withColumns({"__spot": _spot(key), "__bit": _bit(key)})
    bits = F.broadcast(keys.withColumnRenamed("spot", "__spot"))
    hit = F.coalesce(F.expr("(shiftright(bits, __bit) & 1) = 1"), F.lit(False))
    return marked.join(bits, "__spot", "left").withColumn("__maybe", hit).drop("__spot", "__bit", "bits")
