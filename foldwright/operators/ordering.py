"""Exact ranks, prefix sums and quantiles without gathering a group in one task.

A window over a whole class, feature or score column would put that group's
rows in one task. Every function here first splits the group into ordered
buckets, works inside the buckets, and adds the totals of the earlier buckets:

* seeded order: the md5 hex prefix is uniform, so it is the bucket;
* value order: approximate quantiles give balanced cut points. They only decide
  how the work is split; the ranks and quantiles that come out are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.session import cut_lineage

_EARLIER = (Window.unboundedPreceding, -1)
#: Cells of a group between sketched cut points: at least so many, and so many for each wanted rank.
LEAST_CELLS, CELLS_PER_RANK = 64, 4
#: Accuracy of the sketch in parts of a cell, and rows of a cell that one task sorts.
SKETCH, CELL_ROWS = 10, 1_000_000
#: Cut points of all groups together (8 bytes each) that are broadcast; beyond that they are joined.
BROADCAST_CUTS = 2_000_000


def seeded_hash(seed: int, key: str = "row_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))


def prefix_digits(expected_rows: int | None, rows_per_bucket: int = 250_000) -> int:
    """Hex digits of the bucket prefix; ranks do not depend on it.

    Without a row count there are 65,536 buckets, about 15 million rows each at 10**12 rows.
    """
    digits, buckets = 4, 16**4
    while expected_rows and digits < 6 and expected_rows / buckets > rows_per_bucket:
        digits, buckets = digits + 1, buckets * 16
    return digits


def seeded_rank(
    df: DataFrame,
    seed: int,
    group: Sequence[str] = (),
    key: str = "row_id",
    expected_rows: int | None = None,
) -> DataFrame:
    """Rank rows inside each group by the seeded hash of their key.

    Adds ``rn`` (1-based), ``group_n`` (rows of the group) and ``group_offset``
    (rows in groups that sort earlier). Group columns must not be NULL.
    """
    group = list(group)
    digits = prefix_digits(expected_rows)
    spots = ["_bucket", *group]
    keyed = df.withColumn("_bucket", F.substring(seeded_hash(seed, key), 1, digits))
    counts = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # The bucket table holds at most 16^digits rows per group.
    in_group = Window.partitionBy(*(group or [F.lit(0)]))
    starts = counts.withColumn(
        "_start",
        F.coalesce(F.sum("_n").over(in_group.orderBy("_bucket").rowsBetween(*_EARLIER)), F.lit(0)),
    ).withColumn("group_n", F.sum("_n").over(in_group))
    if group:
        sizes = counts.groupBy(*group).agg(F.sum("_n").alias("_size"))
        earlier = Window.partitionBy(F.lit(0)).orderBy(*group).rowsBetween(*_EARLIER)
        offsets = sizes.select(
            *group, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("group_offset")
        )
        starts = starts.join(offsets, group)
    else:
        starts = starts.withColumn("group_offset", F.lit(0).cast("long"))
    # Rows are sent with their prefix only and hashed again where they arrive, which costs less than sending the hash.
    local = F.row_number().over(Window.partitionBy(*spots).orderBy("_hash", key))
    return (
        keyed.repartition(*spots)
        .withColumn("_hash", F.unhex(seeded_hash(seed, key)))
        .withColumn("_local", local)
        .drop("_hash")
        .join(starts.drop("_n"), spots)
        .withColumn("rn", F.col("_start") + F.col("_local"))
        .drop("_bucket", "_local", "_start")
    )


def rank_cuts(
    df: DataFrame,
    seed: int,
    wanted: Callable[[DataFrame], DataFrame],
    group: Sequence[str] = (),
    key: str = "row_id",
    expected_rows: int | None = None,
) -> DataFrame:
    """(group..., ..., cut): the place of the wanted ranks in the seeded order of each group, see seeded_place.

    ``wanted`` gets the group sizes (group..., group_n) and adds the columns rank and any other. The rows of df are counted
    by hash prefix; only those that share a prefix with a wanted rank are ranked, so no row is shuffled for lying before
    or after it. Ranks above a group's size are cut down to it. Group columns must not be NULL.
    """
    group = list(group) or ["_all"]
    base = df if "_all" not in group else df.withColumn("_all", F.lit(0))
    keyed = base.select(*group, seeded_place(seed, key).alias("_place"))
    keyed = keyed.withColumn("_bucket", F.substring("_place.hash", 1, prefix_digits(expected_rows)))
    counts = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    in_group = Window.partitionBy(*group)
    upto = in_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The bucket table holds at most 16^digits rows per group.
    counts = counts.withColumns({"_upto": F.sum("_n").over(upto), "group_n": F.sum("_n").over(in_group)})
    asked = wanted(counts.select(*group, "group_n").distinct()).drop("group_n").join(counts, group)
    rank = F.least("rank", "group_n")
    inside = asked.where((rank > F.col("_upto") - F.col("_n")) & (rank <= F.col("_upto")))
    inside = cut_lineage(inside.withColumn("_local", (rank - F.col("_upto") + F.col("_n")).cast("int")).drop("_n", "_upto", "group_n"))
    spots = [*group, "_bucket"]
    near = keyed.join(F.broadcast(inside.select(*spots).distinct()), spots, "left_semi")
    local = F.row_number().over(Window.partitionBy(*spots).orderBy("_place"))
    hits = near.withColumn("_local", local).join(F.broadcast(inside), [*spots, "_local"])
    return hits.withColumnRenamed("_place", "cut").drop("_bucket", "_local", "_all")


def seeded_place(seed: int, key: str = "row_id") -> Column:
    """A row's place in the seeded order: its hash, ties by the key."""
    return F.struct(seeded_hash(seed, key).alias("hash"), F.col(key).alias("key"))


def value_rows(
    df: DataFrame, columns: Sequence[str], weights: dict[str, Column] | None = None
) -> DataFrame:
    """Long rows (feature, value, weights...), one per cell of the columns; NULL and NaN are left out.

    Nothing is shuffled here; what reads the rows aggregates them before it shuffles.
    """
    weights = weights or {"n": F.lit(1).cast("long")}
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    long = df.select(*[w.alias(name) for name, w in weights.items()], F.inline(pairs))
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.select("feature", "value", *weights)


def _with_value_bucket(
    counts: DataFrame, group: Sequence[str], value: str, buckets: int
) -> DataFrame:
    """Add ``_bucket``: how many cut points lie below the value.

    Groups here are feature, fold, class or leaf ids: their number is bounded by
    the schema or the model, so the table of cut points is broadcast.
    """
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = counts.groupBy(*group).agg(F.percentile_approx(value, cuts, 2000).alias("_cuts"))
    joined = counts.join(F.broadcast(bounds), list(group))
    return with_cuts_below(joined, "_bucket", "_cuts", value, buckets - 1).drop("_cuts")


def with_cuts_below(df: DataFrame, name: str, cuts: str, value: str, most: int) -> DataFrame:
    """df with the column ``name``: how many of the sorted cut points (at most ``most``) lie below the value.

    A bisection with one projection for each step, so that all of it stays in generated code; a lambda over the
    array would be interpreted for every row.
    """
    strides = [1]
    while sum(strides) < most:
        strides.insert(0, strides[0] * 2)
    df = df.withColumn(name, F.lit(0))
    for stride in strides:
        ahead = F.get(cuts, F.col(name) + (stride - 1)) < F.col(value)
        df = df.withColumn(name, F.col(name) + F.when(ahead, stride).otherwise(0))
    return df


def _bucket_starts(
    bucketed: DataFrame, group: Sequence[str], weights: Sequence[str]
) -> DataFrame:
    totals = bucketed.groupBy(*group, "_bucket").agg(
        *[F.sum(w).alias(f"_t_{w}") for w in weights]
    )
    in_group = Window.partitionBy(*group)
    earlier = in_group.orderBy("_bucket").rowsBetween(*_EARLIER)
    for w in weights:
        totals = totals.withColumn(
            f"_s_{w}", F.coalesce(F.sum(f"_t_{w}").over(earlier), F.lit(0))
        ).withColumn(f"_n_{w}", F.sum(f"_t_{w}").over(in_group))
    return totals


def prefix_sums(
    counts: DataFrame,
    group: Sequence[str],
    value: str,
    weights: Sequence[str],
    buckets: int = 64,
) -> DataFrame:
    """For each (group, value) row the summed weights of all smaller values.

    ``counts`` has one row per (group, value). Adds ``before_<w>`` and
    ``total_<w>`` per weight column.
    """
    group = list(group)
    bucketed = _with_value_bucket(counts, group, value, buckets)
    starts = _bucket_starts(bucketed, group, weights)
    inside = Window.partitionBy(*group, "_bucket").orderBy(value).rowsBetween(*_EARLIER)
    out = bucketed
    for w in weights:
        out = out.withColumn(f"_in_{w}", F.coalesce(F.sum(w).over(inside), F.lit(0)))
    out = out.join(starts, [*group, "_bucket"])
    return out.select(
        *counts.columns,
        *[(F.col(f"_s_{w}") + F.col(f"_in_{w}")).alias(f"before_{w}") for w in weights],
        *[F.col(f"_n_{w}").alias(f"total_{w}") for w in weights],
    )


def _cut_cells(rows: DataFrame, group: list[str], value: str, cells: int) -> DataFrame:
    """rows with ``_cell``: twice the number of cut points below the value, plus one for a value that is one.

    Cut points come from a mergeable sketch of each group, its least and greatest value among them, so a value held
    by more than a few of a group's cells is a cut point and has a cell of its own.
    """
    grid = [i / cells for i in range(cells + 1)]
    cuts = F.array_distinct(F.percentile_approx(value, grid, SKETCH * cells))
    bounds = cut_lineage(rows.groupBy(*group).agg(cuts.alias("_cuts")))
    side = F.broadcast(bounds) if bounds.count() * cells <= BROADCAST_CUTS else bounds
    marked = with_cuts_below(rows.join(side, group), "_below", "_cuts", value, cells + 1)
    own = (F.get("_cuts", F.col("_below")) == F.col(value)).cast("int")
    return marked.withColumn("_cell", 2 * F.col("_below") + F.coalesce(own, F.lit(0))).drop("_cuts", "_below")


def _spans(celled: DataFrame, group: list[str], weights: Sequence[str]) -> DataFrame:
    """(group..., weight_set, _spans): for each weight the cells that have any, as (end, start, cell, rows) by value.

    A group has at most a few thousand cells.
    """
    totals = celled.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(w).alias(w) for w in weights])
    upto = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    ends = totals.withColumns({f"_e_{w}": F.sum(w).over(upto) for w in weights})
    span = lambda w: F.struct(F.col(f"_e_{w}").alias("end"), (F.col(f"_e_{w}") - F.col(w)).alias("start"), F.col("_cell").alias("cell"), F.col("_rows").alias("rows"))
    long = ends.select(*group, F.inline(F.array(*[F.struct(F.lit(w).alias("weight_set"), F.col(w).alias("_own"), span(w).alias("_span")) for w in weights])))
    return long.where("_own > 0").groupBy(*group, "weight_set").agg(F.array_sort(F.collect_list("_span")).alias("_spans"))


def _placed(wanted: DataFrame, cells: int) -> DataFrame:
    """wanted(_spans, _rank, ...) with the _cell of the rank, its rank in there and the cell's rows."""
    ended = wanted.withColumns({"_ends": F.col("_spans.end"), "_next": F.col("_rank") + 1})
    found = with_cuts_below(ended, "_at", "_ends", "_next", 2 * cells + 3).withColumn("_hit", F.get("_spans", F.col("_at"))).drop("_ends", "_next", "_at")
    return found.withColumns({"_cell": F.col("_hit.cell"), "_local": F.col("_rank") - F.col("_hit.start"), "_rows": F.col("_hit.rows")}).drop("_hit", "_spans", "_rank")


def _ranked_values(celled: DataFrame, placed: DataFrame, group: list[str], value: str, weights: Sequence[str], cells: int) -> DataFrame:
    """(group..., weight_set, _id, value) for the ranks placed(group..., weight_set, _id, _cell, _local, _rows).

    Only the values of cells in which a rank is wanted are shuffled, equal ones as one row. A cell of more than
    CELL_ROWS rows and several values is cut into cells again, so no task sorts more than that.
    """
    placed = cut_lineage(placed)
    large = (F.col("_rows") > CELL_ROWS) & (F.col("_cell") % 2 == 0)
    key = [*group, "_cell"]
    ready = placed.where(~large)
    inside = celled.join(F.broadcast(ready.select(*key).distinct()), key, "left_semi").groupBy(*key, value).agg(*[F.sum(w).alias(w) for w in weights])
    upto = Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ends = inside.withColumns({f"_e_{w}": F.sum(w).over(upto) for w in weights})
    each = F.array(*[F.struct(F.lit(w).alias("weight_set"), (F.col(f"_e_{w}") - F.col(w)).alias("_from"), F.col(f"_e_{w}").alias("_to")) for w in weights])
    ranges = ends.select(*key, value, F.inline(each)).where("_from < _to")
    out = ranges.join(ready, [*key, "weight_set"]).where("_local >= _from and _local < _to").select(*group, "weight_set", "_id", value)
    open_ = placed.where(large)
    if open_.isEmpty():
        return out
    rename = {"_cell": f"_cell{len(group)}"}
    rows = celled.join(F.broadcast(open_.select(*key).distinct()), key, "left_semi").withColumnsRenamed(rename)
    finer = [*group, rename["_cell"]]
    again = _cut_cells(cut_lineage(rows), finer, value, cells)
    wanted = open_.withColumnsRenamed(rename).select(*finer, "weight_set", "_id", F.col("_local").alias("_rank"))
    nested = _placed(wanted.join(_spans(again, finer, weights), [*finer, "weight_set"]), cells)
    return out.unionByName(_ranked_values(again, nested, finer, value, weights, cells).select(*out.columns))


def quantile_table(
    rows: DataFrame, group: Sequence[str], value: str, weights: Sequence[str], probs: Sequence[float]
) -> DataFrame:
    """Exact linear-interpolated quantiles of weighted values: two passes, one plan at every size.

    ``rows`` has a value per row, or per distinct value, and any number of integer weights: several weight columns
    give several quantile sets from the same passes, e.g. one per training fold. The first pass takes a sketch of
    each group that brackets every wanted rank, the second counts the weights of the cells between its cut points;
    then only the values of the cells that hold a wanted rank are shuffled. NULL and NaN are left out, and so are
    groups with a NULL key. Returns (group..., weight_set, prob_index, prob, quantile).
    """
    group = list(group)
    probs = [float(p) for p in probs]
    cells = max(LEAST_CELLS, CELLS_PER_RANK * len(probs))
    known = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    celled = _cut_cells(known, group, value, cells)
    # each probability asks for the values at the two ranks around p * (n - 1)
    at = F.col("_p") * (F.element_at("_spans", -1)["end"] - 1)
    asked = _spans(celled, group, weights).select("*", F.posexplode(F.array(*[F.lit(p) for p in probs])).alias("prob_index", "_p"))
    asked = asked.withColumns({"_low": F.floor(at), "_share": at - F.floor(at)})
    rank = lambda i: F.struct(F.struct("prob_index", F.col("_p").alias("prob"), F.col("_share").alias("share"), F.lit(i).alias("high")).alias("_id"), (F.col("_low") + i).alias("_rank"))
    wanted = asked.select(*group, "weight_set", "_spans", F.inline(F.array(rank(0), rank(1)))).where("_id.high = 0 or _id.share > 0")
    found = _ranked_values(celled, _placed(wanted, cells), group, value, weights, cells)
    pairs = found.groupBy(*group, "weight_set", F.col("_id.prob_index").alias("prob_index"), F.col("_id.prob").alias("prob")).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.max("_id.share").alias("_share"))
    return pairs.select(*group, "weight_set", "prob_index", "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_share")).alias("quantile"))


def grouped_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles of ``value`` per group as named columns (NULLs left out)."""
    group = list(group)
    keys = group or ["_all"]
    base = df if group else df.withColumn("_all", F.lit(0))
    values = base.select(*keys, F.col(value).cast("double").alias("_value"), F.lit(1).cast("long").alias("n"))
    table = quantile_table(values, keys, "_value", ["n"], list(probs.values()))
    wide = table.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("prob_index") == i, F.col("quantile"))).alias(name)
            for i, name in enumerate(probs)
        ]
    )
    return wide if group else wide.drop("_all")
