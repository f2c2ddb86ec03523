"""Leak-free preprocessing: parameters fitted on training rows, applied as expressions and joins.

Numeric parameters are a few numbers per column and become literals. Category
tables stay DataFrames; they are broadcast only below a checked row count, and
joined with spread-out hot keys above it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions.scalar import normal_ppf_sql
from foldwright.operators.columns import TARGET
from foldwright.operators.ordering import quantile_table, value_rows
from foldwright.operators.traits import RARE_FREQUENCY
from foldwright.session import scratch_path

BROADCAST_ROWS = 200_000
LOCAL_ROWS = 10_000
N_QUANTILES = 1000
CROSSFIT_FOLDS = 5
_EDGE = 1e-7


# ---------------------------------------------------------------- numeric parameters


def _merge_moments(parts: Sequence[tuple[int, float, float]]) -> tuple[int, float, float]:
    """(n, mean, sum of squared deviations) of several disjoint parts."""
    n, mean, m2 = 0, 0.0, 0.0
    for pn, pmean, pm2 in parts:
        if not pn:
            continue
        total = n + pn
        gap = pmean - mean
        m2 += pm2 + gap * gap * n * pn / total
        mean += gap * pn / total
        n = total
    return n, mean, m2


@dataclass
class NumericParams:
    """Fitted numbers of one numeric column."""

    n: int
    n_all: int
    fill: float | None
    center: float = 0.0
    scale: float = 1.0
    quantiles: list[float] = field(default_factory=list)


def numeric_parameters(
    df: DataFrame,
    numeric: Sequence[str],
    imputer: str = "median",
    scaler: str = "standard",
    k: int | None = None,
    n_quantiles: int = N_QUANTILES,
) -> list[dict[str, NumericParams]]:
    """Parameters per column; with ``k`` one set per fold from the other folds' rows.

    ``k`` needs a ``fold`` column. All sets come from the same jobs: moments are
    grouped once per fold and merged over the other folds, quantiles use one
    weight per training set. The folds' columns are kept while the passes run, as
    dealing folds costs more than reading them again.
    """
    numeric = list(numeric)
    sets = 1 if k is None else k
    keyed = df.select("fold", *numeric).persist() if k is not None else df.withColumn("fold", F.lit(0))
    moments: dict[tuple[int, str], tuple[int, float, float]] = {}
    sizes: dict[int, int] = {}
    for row in (
        keyed.groupBy("fold")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[
                a
                for i, c in enumerate(numeric)
                for a in (
                    F.count(c).alias(f"n{i}"),
                    F.avg(F.col(c).cast("double")).alias(f"m{i}"),
                    F.var_pop(F.col(c).cast("double")).alias(f"v{i}"),
                )
            ],
        )
        .collect()
    ):
        sizes[row["fold"]] = row["n"]
        for i, c in enumerate(numeric):
            n = row[f"n{i}"]
            moments[row["fold"], c] = (n, row[f"m{i}"] or 0.0, (row[f"v{i}"] or 0.0) * n)
    trains = [[f for f in sizes if k is None or f != s] for s in range(sets)]
    n_all = [sum(sizes[f] for f in t) for t in trains]
    merged = [{c: _merge_moments([moments[f, c] for f in t]) for c in numeric} for t in trains]

    needs_values = imputer == "median" or scaler in ("robust", "quantile")
    counts = None
    if needs_values:
        weights = {
            f"w{s}": (F.lit(1) if k is None else F.col("fold") != s).cast("long")
            for s in range(sets)
        }
        counts = value_rows(keyed, numeric, weights)
    fills: list[dict[str, float | None]]
    names = [f"w{s}" for s in range(sets)]
    if imputer == "median":
        fills = [{c: None for c in numeric} for _ in range(sets)]
        for r in quantile_table(counts, ["feature"], "value", names, [0.5]).collect():
            fills[int(r["weight_set"][1:])][r["feature"]] = r["quantile"]
    else:
        fills = [{c: (m[1] if m[0] else None) for c, m in merged[s].items()} for s in range(sets)]

    out: list[dict[str, NumericParams]] = []
    for s in range(sets):
        params = {}
        for c in numeric:
            n, mean, m2 = merged[s][c]
            p = NumericParams(n, n_all[s], fills[s][c])
            if scaler == "standard" and n:
                gaps = n_all[s] - n
                total, center, spread = _merge_moments([(n, mean, m2), (gaps, p.fill, 0.0)])
                p.center, p.scale = center, math.sqrt(spread / total) or 1.0
            params[c] = p
        out.append(params)
    if scaler in ("robust", "quantile"):
        imputed = _with_imputed_mass(counts, out, numeric)
        probs = (
            [0.25, 0.5, 0.75]
            if scaler == "robust"
            else [float(v) for v in np.linspace(0, 1, max(2, min(n_quantiles, min(n_all))))]
        )
        found: dict[tuple[int, str], dict[int, float]] = {}
        for r in quantile_table(imputed, ["feature"], "value", names, probs).collect():
            found.setdefault((int(r["weight_set"][1:]), r["feature"]), {})[r["prob_index"]] = r["quantile"]
        for (s, c), q in found.items():
            if scaler == "robust":
                out[s][c].center, out[s][c].scale = q[1], (q[2] - q[0]) or 1.0
            else:
                out[s][c].quantiles = [q[i] for i in range(len(probs))]
    if k is not None:
        keyed.unpersist()
    return out


def _with_imputed_mass(
    counts: DataFrame, params: list[dict[str, NumericParams]], numeric: Sequence[str]
) -> DataFrame:
    """Count the filled-in cells as values too: scalers are fitted after imputation.

    The added rows may repeat a value that is there already; quantiles do not mind.
    """
    rows = []
    for c in numeric:
        for s, fitted in enumerate(params):
            p = fitted[c]
            if p.fill is not None and p.n_all > p.n:
                rows.append((c, float(p.fill), *[p.n_all - p.n if i == s else 0 for i in range(len(params))]))
    if not rows:
        return counts
    added = counts.sparkSession.createDataFrame(rows, counts.schema)
    return counts.unionByName(added)


def fold_parameter_table(
    spark, fitted: list[dict[str, NumericParams]]
) -> DataFrame:
    """Fitted numbers of all folds as (fold, feature, fill, center, scale) rows."""
    rows = [
        (s, c, p.fill, p.center, p.scale) for s, params in enumerate(fitted) for c, p in params.items()
    ]
    return spark.createDataFrame(
        rows, "fold int, feature string, fill double, center double, scale double"
    )


def quantile_position(column: Column, quantiles: Sequence[float]) -> Column:
    """Position in the reference quantiles, 0..1, midpoint on ties.

    One Arrow-batched interpolation; a higher-order function over 1000 literals
    per cell would be far slower.
    """
    q = np.asarray(quantiles, dtype=float)
    refs = np.linspace(0.0, 1.0, q.size)

    @F.pandas_udf("double")
    def position(values: pd.Series) -> pd.Series:
        x = values.to_numpy(dtype=float)
        up = np.interp(x, q, refs)
        down = -np.interp(-x, -q[::-1], -refs[::-1])
        out = (up + down) / 2
        out[x - _EDGE < q[0]] = 0.0
        out[x + _EDGE > q[-1]] = 1.0
        return pd.Series(out)

    return position(column)


def apply_numeric(
    df: DataFrame, params: dict[str, NumericParams], scaler: str
) -> tuple[DataFrame, list[str]]:
    """Imputed and scaled columns in place; columns without any value are dropped."""
    kept = [c for c, p in params.items() if p.fill is not None]
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(params[c].fill))) for c in kept}
    if scaler == "quantile":
        df = df.withColumns({c: quantile_position(filled[c], params[c].quantiles) for c in kept})
        clipped = "least(greatest(`{0}`, 1e-7), 1e0 - 1e-7)"
        df = df.withColumns({c: F.expr(clipped.format(c)) for c in kept})
        return df.withColumns({c: F.expr(normal_ppf_sql(f"`{c}`")) for c in kept}), kept
    if scaler == "none":
        return df.withColumns(filled), kept
    return (
        df.withColumns(
            {c: (filled[c] - F.lit(params[c].center)) / F.lit(params[c].scale) for c in kept}
        ),
        kept,
    )


# ---------------------------------------------------------------- categories


def category_counts(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """(feature, category, n) with NULL categories kept as NULL."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category"))
            for c in categorical
        ]
    )
    return df.select(F.inline(pairs)).groupBy("feature", "category").agg(
        F.count(F.lit(1)).alias("n")
    )


def most_frequent(counts: DataFrame) -> DataFrame:
    """Modal category per feature, the smallest on ties (one mergeable aggregate)."""
    return (
        counts.filter(F.col("category").isNotNull())
        .groupBy("feature")
        .agg(F.min(F.struct((-F.col("n")).alias("less"), "category")).alias("best"))
        .select("feature", F.col("best.category").alias("fill"))
    )


def fill_categories(df: DataFrame, fills: dict[str, str | None]) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit(v)) for c, v in fills.items()}
    )


def imputed_counts(counts: DataFrame, fills: dict[str, str | None]) -> DataFrame:
    """Counts after imputation: NULL cells count for the modal category."""
    spark = counts.sparkSession
    table = spark.createDataFrame(list(fills.items()), "feature string, fill string")
    return (
        counts.join(F.broadcast(table), "feature")
        .select("feature", F.coalesce("category", "fill").alias("category"), "n")
        .groupBy("feature", "category")
        .agg(F.sum("n").alias("n"))
    )


def lookup_join(
    df: DataFrame, column: str, table: DataFrame, rows: int, hot: Sequence[str] = ()
) -> DataFrame:
    """Left join of a category table (category, payload...) on ``column``.

    At most BROADCAST_ROWS rows are broadcast. A larger table is joined by
    shuffle in two parts: the few hot categories by a small broadcast, the
    rest, each of a small share of the rows, by key.
    """
    right = table.withColumnRenamed("category", "_category")
    payload = [c for c in right.columns if c != "_category"]
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(right), F.col(column) == F.col("_category"), "left").drop("_category")
    hot = list(hot)
    hot_rows = right.filter(F.col("_category").isin(*hot)).select(
        F.col("_category").alias("_hot"), F.struct(*payload).alias("_hot_payload")
    )
    keyed = df.join(F.broadcast(hot_rows), F.col(column) == F.col("_hot"), "left")
    # Rows already answered get a spread key that matches nothing.
    spread = F.concat(F.lit("\u0000"), F.xxhash64("row_id").cast("string"))
    keyed = keyed.withColumn("_key", F.when(F.col("_hot").isNotNull(), spread).otherwise(F.col(column)))
    rest = right.filter(~F.col("_category").isin(*hot)).select(
        "_category", F.struct(*payload).alias("_rest_payload")
    )
    joined = keyed.join(rest, F.col("_key") == F.col("_category"), "left")
    both = F.coalesce("_hot_payload", "_rest_payload")
    return joined.withColumns({p: both[p] for p in payload}).drop(
        "_hot", "_hot_payload", "_rest_payload", "_key", "_category"
    )


def onehot_table(counts: DataFrame, n_rows: int, min_frequency: float = RARE_FREQUENCY) -> DataFrame:
    """(feature, category, slot): kept categories in sorted order, rare ones share the last slot.

    A kept category holds at least 1 % of the rows, so there are at most 100 per feature.
    """
    kept = counts.filter(F.col("n") >= min_frequency * n_rows)
    by_name = Window.partitionBy("feature").orderBy("category")
    slots = kept.select("feature", "category", (F.row_number().over(by_name) - 1).alias("slot"))
    sizes = slots.groupBy("feature").agg(F.count(F.lit(1)).alias("k"))
    rare = (
        counts.filter(F.col("n") < min_frequency * n_rows)
        .join(F.broadcast(sizes), "feature", "left")
        .select("feature", "category", F.coalesce("k", F.lit(0)).cast("int").alias("slot"))
    )
    return slots.unionByName(rare)


def ordinal_table(counts: DataFrame) -> DataFrame:
    """(feature, category, code) by sorted category, over the distinct categories."""
    by_name = Window.partitionBy("feature").orderBy("category")
    return counts.select(
        "feature", "category", (F.dense_rank().over(by_name) - 1).cast("double").alias("code")
    )


def crossfit_fold(seed: int, key: str = "row_id") -> Column:
    """Internal fold of a row for target encoding."""
    digest = F.md5(F.concat(F.lit(f"te{seed}:"), F.col(key)))
    return (F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") % CROSSFIT_FOLDS).cast("int")


def _shrunk(n: Column, s: Column, ss: Column, mean: float, variance: float) -> Column:
    own = s / n
    within = F.greatest(ss / n - own * own, F.lit(0.0))
    weight = n * variance / F.nullif(n * variance + within, F.lit(0.0))
    return F.when(n > 0, F.coalesce(weight * own + (1 - weight) * mean, F.lit(mean))).otherwise(
        F.lit(mean)
    )


def target_encoding(
    df: DataFrame, categorical: Sequence[str], task: str, seed: int, classes: int = 2
) -> tuple[DataFrame, list[float]]:
    """Encoding table and the global means.

    The table has (feature, category, n, enc, enc_cf): ``enc`` one value per
    target column from all rows, ``enc_cf[f]`` the same without internal fold f,
    got by subtraction of that fold's sums. Regression and binary targets have
    one column, others one per class. Shrinkage is empirical Bayes.
    """
    if task == "regression":
        base = df.agg(F.avg(TARGET)).first()[0] or 0.0
        targets = [(F.col(TARGET).cast("double") - F.lit(base))]
    else:
        base = 0.0
        wanted = [1] if classes == 2 else list(range(classes))
        targets = [(F.col(TARGET) == c).cast("double") for c in wanted]
    y = [f"y{i}" for i in range(len(targets))]
    rows = df.select(
        *[F.col(c).cast("string").alias(c) for c in categorical],
        crossfit_fold(seed).alias("cf"),
        *[t.alias(name) for t, name in zip(targets, y)],
    )
    overall = {
        r["cf"]: r
        for r in rows.groupBy("cf")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(c).alias(f"s_{c}") for c in y],
            *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in y],
        )
        .collect()
    }

    def moments(column: str, without: int | None) -> tuple[float, float]:
        use = [r for cf, r in overall.items() if cf != without]
        n = sum(r["n"] for r in use) or 1
        mean = sum(r[f"s_{column}"] for r in use) / n
        return mean, max(sum(r[f"q_{column}"] for r in use) / n - mean * mean, 0.0)

    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).alias("category")) for c in categorical]
    )
    folds = range(CROSSFIT_FOLDS)
    one = lambda f: F.when(F.col("cf") == f, 1).otherwise(0)
    per = rows.select(F.inline(pairs), "cf", *y).groupBy("feature", "category").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(one(f)).alias(f"n_{f}") for f in folds],
        *[F.sum(c).alias(f"s_{c}") for c in y],
        *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in y],
        *[F.sum(F.col(c) * one(f)).alias(f"s_{c}_{f}") for c in y for f in folds],
        *[F.sum(F.col(c) * F.col(c) * one(f)).alias(f"q_{c}_{f}") for c in y for f in folds],
    )

    def encode(c: str, f: int | None) -> Column:
        mean, variance = moments(c, f)
        n, s, q = F.col("n"), F.col(f"s_{c}"), F.col(f"q_{c}")
        if f is not None:
            n, s, q = n - F.col(f"n_{f}"), s - F.col(f"s_{c}_{f}"), q - F.col(f"q_{c}_{f}")
        return _shrunk(n, s, q, mean, variance) + F.lit(base)

    table = per.select(
        "feature",
        "category",
        "n",
        F.array(*[encode(c, None) for c in y]).alias("enc"),
        F.array(*[F.array(*[encode(c, f) for c in y]) for f in folds]).alias("enc_cf"),
    )
    return table, [moments(c, None)[0] + base for c in y]


# ---------------------------------------------------------------- the whole step


@dataclass
class Preprocessor:
    """Numeric branch impute -> scale, categorical branch impute -> encode."""

    numeric: list[str]
    categorical: list[str]
    task: str
    numeric_imputer: str = "median"
    scaler: str = "standard"
    cat_encoder: str = "onehot"
    seed: int = 0
    classes: int = 2
    n_quantiles: int = N_QUANTILES

    def fit(self, train: DataFrame) -> FittedPreprocessor:
        fitted = FittedPreprocessor(self)
        if self.numeric:
            fitted.numbers = numeric_parameters(
                train, self.numeric, self.numeric_imputer, self.scaler, n_quantiles=self.n_quantiles
            )[0]
        if self.categorical:
            self._fit_categories(train, fitted)
        return fitted

    def _fit_categories(self, train: DataFrame, fitted: FittedPreprocessor) -> None:
        counts = category_counts(train, self.categorical).cache()
        fills = {c: None for c in self.categorical}
        fills.update({r["feature"]: r["fill"] for r in most_frequent(counts).collect()})
        fitted.fills = {c: v for c, v in fills.items() if v is not None}
        features = list(fitted.fills)
        full = imputed_counts(counts, fitted.fills)
        sizes = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()
        n_rows, n_categories = sizes[0]["n"], sum(r["k"] for r in sizes)
        if self.cat_encoder == "onehot":
            table = onehot_table(full, n_rows)
        elif self.cat_encoder == "ordinal":
            table = ordinal_table(full)
        else:
            table, fitted.target_means = target_encoding(
                fill_categories(train, fitted.fills), features, self.task, self.seed, self.classes
            )
        # The table is read by every later transform of this fold: a small one becomes
        # local rows, any other is written once.
        spark = train.sparkSession
        if n_categories <= LOCAL_ROWS:
            local = table.collect()
            fitted.table = spark.createDataFrame(local, table.schema)
            for r in local:
                fitted.sizes[r["feature"]] = fitted.sizes.get(r["feature"], 0) + 1
                if self.cat_encoder == "onehot":
                    fitted.slots[r["feature"]] = max(fitted.slots.get(r["feature"], 0), r["slot"] + 1)
        else:
            path = scratch_path(spark, "categories")
            table.write.partitionBy("feature").parquet(path)
            fitted.table = spark.read.schema(table.schema).parquet(path)
            found = fitted.table.groupBy("feature").agg(
                F.count(F.lit(1)).alias("rows"),
                *([F.max("slot").alias("last")] if self.cat_encoder == "onehot" else []),
            )
            for r in found.collect():
                fitted.sizes[r["feature"]] = r["rows"]
                if self.cat_encoder == "onehot":
                    fitted.slots[r["feature"]] = r["last"] + 1
            # Hot categories (at least 1 % of the rows each) matter for shuffled lookups only.
            for r in full.filter(F.col("n") >= RARE_FREQUENCY * n_rows).collect():
                fitted.hot.setdefault(r["feature"], []).append(r["category"])
        counts.unpersist()


@dataclass
class FittedPreprocessor:
    spec: Preprocessor
    numbers: dict[str, NumericParams] = field(default_factory=dict)
    fills: dict[str, str | None] = field(default_factory=dict)
    table: DataFrame | None = None
    sizes: dict[str, int] = field(default_factory=dict)
    slots: dict[str, int] = field(default_factory=dict)
    hot: dict[str, list[str]] = field(default_factory=dict)
    target_means: list[float] = field(default_factory=list)

    @property
    def feature_names(self) -> list[str]:
        names = [c for c, p in self.numbers.items() if p.fill is not None]
        for c in self.fills:
            if self.spec.cat_encoder == "onehot":
                names += [f"{c}_{i}" for i in range(self.slots[c])]
            elif self.spec.cat_encoder == "ordinal":
                names.append(c)
            else:
                names += (
                    [c] if len(self.target_means) == 1
                    else [f"{c}_class{i}" for i in range(len(self.target_means))]
                )
        return names

    def transform(self, df: DataFrame, training: bool = False) -> DataFrame:
        """Add ``features`` (array of doubles) and drop the raw columns.

        ``training`` selects the cross-fitted target encodings.
        """
        raw = [*self.spec.numeric, *self.spec.categorical]
        out, parts = df, []
        if self.numbers:
            out, kept = apply_numeric(out, self.numbers, self.spec.scaler)
            if kept:
                parts.append(F.array(*[F.col(c) for c in kept]))
        if self.fills:
            out = fill_categories(out, self.fills)
            for i, c in enumerate(self.fills):
                out, part = self._encode(out, c, f"_enc{i}", training)
                parts.append(part)
        features = F.concat(*parts) if len(parts) > 1 else parts[0]
        keep = [c for c in df.columns if c not in raw]
        return out.select(*keep, features.alias("features"))

    def _encode(self, df: DataFrame, c: str, name: str, training: bool) -> tuple[DataFrame, Column]:
        table = self.table.filter(F.col("feature") == c).drop("feature")
        kind = self.spec.cat_encoder
        if kind == "onehot":
            table = table.withColumnRenamed("slot", name)
        elif kind == "ordinal":
            table = table.withColumnRenamed("code", name)
        else:
            table = table.select("category", F.struct("enc", "enc_cf").alias(name))
        joined = lookup_join(df, c, table, self.sizes[c], self.hot.get(c, ()))
        if kind == "onehot":
            slots = F.sequence(F.lit(0), F.lit(self.slots[c] - 1))
            hit = F.transform(slots, lambda i: F.coalesce((i == F.col(name)).cast("double"), F.lit(0.0)))
            return joined, hit
        if kind == "ordinal":
            return joined, F.array(F.coalesce(F.col(name), F.lit(-1.0)))
        unseen = F.array(*[F.lit(float(m)) for m in self.target_means])
        if training:
            return joined, F.coalesce(
                F.get(F.col(name)["enc_cf"], crossfit_fold(self.spec.seed)), unseen
            )
        return joined, F.coalesce(F.col(name)["enc"], unseen)
