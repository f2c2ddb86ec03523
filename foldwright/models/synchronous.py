"""Synchronous mini-batch training: one Spark job for each step, summed in a fixed order.

A seeded hash of the key deals the rows into the ``steps`` mini-batches of an epoch and, within each, into ``blocks``. A
step's job adds up what the rows of each block contribute, in hash order; the driver adds the blocks in their order and
makes the move. Steps and blocks are parameters, so neither the input's partitions, nor the number of cores, nor the
number of rows changes what a step is, and equal rows give equal weights. Blocks of more than SLICE_ROWS rows are cut
into slices of the hash order, each in a partition of its own and added in order, so no task's rows grow with the table.
Lost executors repeat the tasks that they had, as with any job. A task holds one chunk of rows at a time; the driver
gets one vector for each block or slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.models.arrays import block_arrays, list_column, matrix, vector
from foldwright.operators.columns import TARGET

STEPS, BLOCKS = 8, 32
#: The mini-batch of the rows that are held out.
HELD_OUT = -1
#: Rows whose contribution is taken at once.
CHUNK_ROWS = 16_384
#: Rows of a partition beyond which a block is cut into slices of its hash order.
SLICE_ROWS = 524_288

Contribution = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def lay_out(df: DataFrame, steps: int = STEPS, blocks: int = BLOCKS, seed: int = 0, held_out: Column | None = None) -> DataFrame:
    """df(row_id, features, target) with its mini-batch and block, each block's rows together and in hash order."""
    draw = F.xxhash64(F.lit(seed), "row_id")
    step = F.pmod(draw, F.lit(steps)).cast("int")
    if held_out is not None:
        step = F.when(held_out, HELD_OUT).otherwise(step)
    block = F.pmod(F.shiftrightunsigned(draw, 20), F.lit(blocks)).cast("int")
    marked = df.select("row_id", F.col(TARGET).cast("double").alias(TARGET), "features", step.alias("mini_batch"), block.alias("block"), draw.alias("draw"))
    # Partitions are dealt by number, as hashed blocks would fall together; their number grows with the rows.
    rows = df.count()
    slices = max(1, -(-rows // (blocks * SLICE_ROWS)))
    if slices > 1:
        parts = blocks * slices
        part = F.col("block") * slices + F.least(F.floor((F.col("draw") / 2.0**64 + 0.5) * slices), F.lit(slices - 1))
    else:
        parts = max(1, min(blocks, max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // SLICE_ROWS))))
        part = F.floor(F.col("block") * parts / blocks)
    marked = marked.withColumn("part", part.cast("int"))
    return marked.repartitionById(parts, "part").sortWithinPartitions("mini_batch", "block", "draw", "row_id").select(TARGET, "features", "mini_batch", "block")


def packed(laid_out: DataFrame) -> DataFrame:
    """The rows of lay_out as blocks of one mini-batch and block, in their order, with features and target as bytes.

    The steps of a fit read these, so that no row is converted in every step.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            step, block, x, y = vector(batch, "mini_batch", np.int32), vector(batch, "block", np.int32), matrix(batch), vector(batch, TARGET)
            edges = np.flatnonzero((np.diff(step) != 0) | (np.diff(block) != 0)) + 1
            runs = list(zip([0, *edges], [*edges, len(y)]))
            first = np.array([a for a, _ in runs])
            cells = [pa.array([np.ascontiguousarray(v[a:b]).tobytes() for a, b in runs], pa.binary()) for v in (y, x)]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(step[first]), pa.array(block[first])], [TARGET, "features", "mini_batch", "block"])

    return laid_out.mapInArrow(run, f"`{TARGET}` binary, features binary, mini_batch int, block int")


def row_width(blocks: DataFrame) -> int:
    """Features of a row of packed blocks."""
    return blocks.select((F.length("features") / F.length(TARGET)).cast("int")).first()[0]


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, x, y) of the rows of a batch that lie together, of packed or of plain rows."""
    block = vector(batch, "block", np.int64)
    if pa.types.is_binary(batch.schema.field(TARGET).type):
        for number, rows in zip(block, block_arrays(batch, {TARGET: np.float64, "features": np.float64}, TARGET)):
            yield int(number), rows["features"], rows[TARGET]
        return
    x, y = matrix(batch), vector(batch, TARGET)
    edges = np.flatnonzero(np.diff(block)) + 1
    for first, last in zip([0, *edges], [*edges, len(block)]):
        yield int(block[first]), x[first:last], y[first:last]


def target_scale(laid_out: DataFrame) -> tuple[float, float]:
    """Mean and standard deviation (1 for a constant) of the target, added up in block order."""
    n, mean, m2 = 0, 0.0, 0.0
    parts = summed_blocks(laid_out, None, lambda x, y, block: np.array([y.sum(), (y * y).sum()]))
    for rows, (total, squares) in parts:
        m, gap = total / rows, total / rows - mean
        m2 += max(0.0, squares - rows * m * m) + gap * gap * n * rows / (n + rows)
        mean, n = mean + gap * rows / (n + rows), n + rows
    return mean, (float(np.sqrt(m2 / n)) if n else 0.0) or 1.0


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, x, y) of at most CHUNK_ROWS rows; where the batches end does not matter."""
    at, held = None, []
    for block, x, y in (piece for batch in batches if batch.num_rows for piece in _pieces(batch)):
        if held and at != block:
            yield at, *(np.concatenate(part) for part in zip(*held))
            held = []
        at = block
        held.append((x, y))
        rows = sum(len(part[1]) for part in held)
        if rows >= CHUNK_ROWS:
            whole_x, whole_y = (np.concatenate(part) for part in zip(*held))
            full = rows // CHUNK_ROWS * CHUNK_ROWS
            for start in range(0, full, CHUNK_ROWS):
                yield at, whole_x[start : start + CHUNK_ROWS], whole_y[start : start + CHUNK_ROWS]
            held = [(whole_x[full:], whole_y[full:])] if rows > full else []
    if held:
        yield at, *(np.concatenate(part) for part in zip(*held))


def summed_blocks(laid_out: DataFrame, mini_batch: int | None, contribution: Contribution) -> list[tuple[float, np.ndarray]]:
    """(rows, sums) of each block, or slice of one, with rows, in block order; of one mini-batch, or of all rows if it is None.

    Rows lie by mini-batch, so of a persisted layout only the cached blocks of the asked one are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for block, x, y in _chunks(batches):
            part = np.concatenate([[block, len(y)], contribution(x, y, block)])
            if block in totals:
                totals[block][1:] += part[1:]
            else:
                totals[block] = part
        for part in totals.values():
            yield pa.RecordBatch.from_arrays([list_column(part[None, :])], ["sums"])

    rows = laid_out if mini_batch is None else laid_out.where(F.col("mini_batch") == mini_batch)
    found = rows.select(TARGET, "features", "block").mapInArrow(run, "sums array<double>").collect()
    return [(part[1], part[2:]) for part in sorted((np.asarray(r["sums"]) for r in found), key=lambda part: part[0])]


def summed_step(laid_out: DataFrame, mini_batch: int | None, contribution: Contribution) -> tuple[float, np.ndarray | None]:
    """(rows, sums) of a mini-batch, None for one without rows."""
    n, total = 0.0, None
    for rows, sums in summed_blocks(laid_out, mini_batch, contribution):
        n, total = n + rows, sums if total is None else total + sums
    return n, total
