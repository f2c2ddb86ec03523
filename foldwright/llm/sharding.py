"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split.

Every row has a 63-bit key, a function of its content; a bucket is a prefix of it. Buckets of more bytes than the limit
split on the next bit, the others don't, from the one bucket of all rows on, until each bucket fits. Bytes are first
added up for cells of a fixed depth; all levels down to that of the cells are derived from those sums, and only if a
cell itself is too large are its rows looked at again, some bits deeper. The directory has one line per shard: its
prefix and local depth. Rows that share all bits are repeated rows; if they do not fit together they are numbered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.session import cut_lineage

LIMIT_BYTES = 1 << 20
#: Bits that the cells have beyond the depth at which a bucket would fit on average.
STEP_BITS = 6
IDENTITY_BITS, ROW_BITS = 32, 31
KEY_BITS = IDENTITY_BITS + ROW_BITS
#: Directories of up to so many cells are broadcast, larger ones joined; full shards that one task numbers rows for.
BROADCAST_CELLS, TASK_SHARDS = 200_000, 64


@dataclass
class Directory:
    """cells(cell, cell_depth, prefix, local_depth, bytes, docs) and the depths of the cells."""

    cells: DataFrame
    depths: list[int]

    def shards(self) -> DataFrame:
        """(shard, prefix, local_depth, bytes, docs), one row per shard."""
        found = self.cells.groupBy("prefix", "local_depth").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
        return found.select(shard_name().alias("shard"), "prefix", "local_depth", "bytes", "docs")


def shard_name() -> Column:
    """local depth and prefix, such as 03-5."""
    return F.concat(F.lpad(F.col("local_depth").cast("string"), 2, "0"), F.lit("-"), F.col("prefix").cast("string"))


def hash_key(identity: list[str], columns: list[str]) -> Column:
    """32 bits of the row's identity, then 31 of all its columns, so that rows of one identity can be parted too."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity])
    first = F.conv(F.substring(F.md5(text), 1, IDENTITY_BITS // 4), 16, 10).cast("long")
    rest = F.xxhash64(*columns).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return F.shiftleft(first, ROW_BITS).bitwiseOR(rest)


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftright(key, KEY_BITS - depth)


def _least_fitting(sums: DataFrame, low: int, depth: int, limit: int) -> DataFrame:
    """(cell, at) for cells of ``depth`` bits: the shortest prefix of low to depth bits that fits, if there is one."""
    levels = sums.withColumn("level", F.explode(F.sequence(F.lit(low), F.lit(depth))))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {depth} - level)"))
    fitting = levels.groupBy("level", "prefix").agg(F.sum("bytes").alias("total")).where(F.col("total") <= limit).select("level", "prefix")
    return levels.join(fitting, ["level", "prefix"]).groupBy("cell").agg(F.min(F.struct("level", "prefix")).alias("at"))


def _split(sums: DataFrame, low: int, middle: int, depth: int, limit: int) -> DataFrame:
    """Cells (cell, bytes, docs) of ``depth`` bits with the bucket that each falls into, prefix and local_depth.

    The bucket is the shortest prefix of low to depth bits that fits; a cell that does not fit itself has
    local_depth null. Prefixes shorter than ``middle`` bits are tried on sums of that depth, of which there are few.
    """
    lower = _least_fitting(sums, middle, depth, limit).withColumnRenamed("at", "low_at")
    out = sums.join(lower, "cell", "left").withColumn("upper", F.expr(f"shiftright(cell, {depth - middle})"))
    if low < middle:
        few = sums.groupBy(F.expr(f"shiftright(cell, {depth - middle})").alias("cell")).agg(F.sum("bytes").alias("bytes"))
        top = _least_fitting(few, low, middle, limit).select(F.col("cell").alias("upper"), F.col("at").alias("top_at"))
        out = out.join(top, "upper", "left").withColumn("low_at", F.coalesce("top_at", "low_at"))
    return out.select("cell", F.lit(depth).alias("cell_depth"), "bytes", "docs", "low_at.prefix", F.col("low_at.level").alias("local_depth"))


def build_directory(keyed: DataFrame, limit: int = LIMIT_BYTES, step: int = STEP_BITS) -> Directory:
    """The directory of keyed(key, bytes). What still does not fit at the last depth is a bucket there: one row larger
    than the limit, or repeated rows."""
    total = keyed.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    low, middle = 0, max(0, min((max(total, 1) // limit).bit_length() - 1, 40))
    depth, cells, depths, open_cells = min(middle + step, KEY_BITS), None, [], None
    while True:
        rows = keyed.withColumn("cell", _prefix(F.col("key"), depth))
        if open_cells is not None:
            rows = rows.join(open_cells, _prefix(F.col("key"), depths[-1]) == F.col("parent"), "left_semi")
        sums = rows.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
        found = cut_lineage(_split(sums, low, middle, depth, limit))
        depths.append(depth)
        large = found.where(F.col("local_depth").isNull() & (F.col("docs") > 1))
        last = depth == KEY_BITS
        settled = found if last else found.where(F.col("local_depth").isNotNull() | (F.col("docs") <= 1))
        settled = settled.withColumn("prefix", F.coalesce("prefix", "cell")).withColumn("local_depth", F.coalesce("local_depth", "cell_depth"))
        cells = settled if cells is None else cells.union(settled)
        if last or large.isEmpty():
            return Directory(cut_lineage(cells), depths)
        open_cells = large.select(F.col("cell").alias("parent"))
        low = middle = depth + 1
        depth = min(depth + step, KEY_BITS)


def _numbered(rows: DataFrame, limit: int) -> DataFrame:
    """rows(shard, __total, __most, __key, ...) of buckets of repeated rows, each bucket dealt into shards that fit.

    Rows are dealt by row number into parts of about TASK_SHARDS full shards each and counted off inside a part; they
    lie in a checkpoint, so that a repeated task sees the same numbers.
    """
    kept = cut_lineage(rows)
    parts = F.ceil(F.col("__total") / (F.lit(limit) * TASK_SHARDS))
    dealt = kept.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.greatest(parts, F.lit(1))))
    turn = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("__key")) - 1
    room = F.greatest(F.floor(limit / F.greatest(F.col("__most"), F.lit(1))), F.lit(1))
    name = F.concat_ws("-", "shard", F.col("__part").cast("string"), F.floor(turn / room).cast("string"))
    return dealt.withColumn("shard", name)


def assign_shards(docs: DataFrame, limit: int = LIMIT_BYTES, identity: list[str] | None = None) -> DataFrame:
    """docs(text, ...) with shard and bytes (of the text in UTF-8; null: 0), every shard within the limit.

    identity names the columns whose hash places a row, all columns with an atomic type if it is not given; rows of
    equal identity are parted by their other columns, and repeated rows, where they do not fit together, are counted
    off, equal rows being alike. A row larger than the limit is a shard of its own. Rows of 0 bytes are placed like
    others; texts may have any length. No row is lost: one whose bucket is missing stops the job. Existing columns
    shard and bytes are replaced; an empty table gives no rows.
    """
    docs = docs.drop("shard", "bytes")
    columns = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    key = hash_key(identity or columns, columns)
    sized = docs.withColumns({"bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "__key": key})
    directory = build_directory(cut_lineage(sized.select(F.col("__key").alias("key"), "bytes")), limit)
    crowded = (F.col("cell_depth") == KEY_BITS) & (F.col("docs") > 1) & (F.col("bytes") > limit)
    cells = directory.cells.select("cell", "cell_depth", shard_name().alias("__shard"), crowded.alias("crowded"), F.col("bytes").alias("total"))
    few = cells.count() <= BROADCAST_CELLS
    # a row's cell is settled at exactly one of the depths: one, unless a bucket was far above the average
    names, placed = [], sized
    for depth in directory.depths:
        side = cells.where(F.col("cell_depth") == depth).select(F.col("cell").alias("__cell"), F.struct("__shard", "crowded", "total").alias(f"__at{depth}"))
        placed = placed.join(F.broadcast(side) if few else side, _prefix(F.col("__key"), depth) == F.col("__cell"), "left").drop("__cell")
        names.append(f"__at{depth}")
    placed = placed.withColumn("__at", F.coalesce(*names)).drop(*names)
    missing = F.raise_error(F.lit("a row's bucket is not in the directory")).cast("string")
    placed = placed.withColumn("shard", F.coalesce("__at.__shard", missing))
    out = [*docs.columns, "shard", "bytes"]
    if cells.where("crowded").isEmpty():
        return placed.select(*out)
    alone = placed.where("not __at.crowded").select(*out)
    together = placed.where("__at.crowded").withColumns({"__total": F.col("__at.total"), "__most": F.col("bytes")})
    return alone.unionByName(_numbered(together.select(*out, "__key", "__total", "__most"), limit).select(*out))


def write_shards(assigned: DataFrame, path: str) -> None:
    """The rows as Parquet, one folder for each shard, each written by one task as it fits a shard's limit."""
    assigned.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
