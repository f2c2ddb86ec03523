"""Arrow helpers: feature matrices in tasks, distributed vector sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which an input is dealt into partitions anew for an iterative fit.
SMALL_ROWS = 2_000_000


def matrix(batch: pa.RecordBatch, name: str = "features", dtype=float) -> np.ndarray:
    """A list column, or packed cells, as an n x d matrix."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_binary(column.type):
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + batch.num_rows + 1]
        cells = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]]
        return cells.view(dtype).reshape(batch.num_rows, -1 if batch.num_rows else 0)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, dtype=dtype).reshape(batch.num_rows, -1 if batch.num_rows else 0)


def vector(batch: pa.RecordBatch, name: str, dtype=float) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=dtype)


def list_column(values: np.ndarray) -> pa.Array:
    """An n x d matrix as a list column."""
    n, d = values.shape
    offsets = np.arange(0, (n + 1) * d, d, dtype=np.int32) if d else np.zeros(n + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))


def packed_column(values: np.ndarray) -> pa.Array:
    """An n x d matrix as one binary cell per row: cheap to move between JVM and Python."""
    n = len(values)
    width = values.dtype.itemsize * values.shape[1]
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    data = np.ascontiguousarray(values)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def packed_rows(df: DataFrame, compute: Callable[[pa.RecordBatch], dict[str, np.ndarray]], names: Sequence[str]) -> DataFrame:
    """Blocks of rows, one for each Arrow batch: a row has the cells of all its rows in a binary column for each array.

    A pass then moves a few cells of bytes between JVM and Python where it would convert every row. ``compute`` gives
    arrays with a row (or a number) for each row of the batch; their types are the reader's to know, see block_arrays.
    """
    names = list(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = compute(batch)
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(found[n]).tobytes()], pa.binary()) for n in names], names)

    return df.mapInArrow(run, ", ".join(f"`{n}` binary" for n in names))


def block_arrays(batch: pa.RecordBatch, types: dict[str, type], rows: str) -> Iterator[dict[str, np.ndarray]]:
    """The arrays of each packed block of a batch; column ``rows`` has one number a row, a column of more is a matrix."""
    columns = {n: batch.column(batch.schema.get_field_index(n)) for n in types if batch.schema.get_field_index(n) >= 0}
    for i in range(batch.num_rows):
        found = {n: np.frombuffer(c[i].as_buffer(), dtype=types[n]) for n, c in columns.items()}
        n_rows = len(found[rows])
        yield {n: v if n == rows else v.reshape(n_rows, -1) for n, v in found.items()}


def with_computed(
    df: DataFrame,
    compute: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    fields: Sequence[T.StructField],
    drop: Sequence[str] = (),
) -> DataFrame:
    """Append columns computed per Arrow batch."""
    kept = [c for c in df.columns if c not in drop]
    schema = T.StructType([*[df.schema[c] for c in kept], *fields])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = compute(batch)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, *[new[n] for n in names]], [*kept, *names])

    return df.mapInArrow(run, schema)


def spread(df: DataFrame, n_rows: int, parts: int = 8, small: int = SMALL_ROWS) -> DataFrame:
    """Give a small table from few files enough partitions for an iterative fit.

    Larger inputs already have many partitions and are not shuffled.
    """
    return df.repartition(parts, "row_id") if n_rows <= small else df


def summed_vectors(
    vectors: DataFrame, parts: int | None = None, fan_in: int = 64
) -> list[np.ndarray]:
    """Sum array<double> columns over all rows (one row per partition).

    Up to ``fan_in`` rows are summed on the driver; more, or an unknown number,
    are first summed in tasks.
    """
    names = vectors.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = [matrix(batch, n).sum(axis=0) for n in names]
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([list_column(v[None, :]) for v in total], names)

    if parts is None or parts > fan_in:
        vectors = vectors.repartition(min(fan_in, 8)).mapInArrow(add, vectors.schema)
    total = None
    for row in vectors.collect():
        part = [np.asarray(row[n]) for n in names]
        total = part if total is None else [a + b for a, b in zip(total, part)]
    return total
