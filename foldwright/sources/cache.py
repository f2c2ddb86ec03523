"""Parquet cache of datasets, checksum manifest and content fingerprint."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from foldwright.operators.columns import downcast, nan_to_null
from foldwright.operators.validate import validate
from foldwright.sources.registry import DatasetSpec

#: Bytes of a file's chunk, which ends with the line that fills it; a shuffled row holds one chunk.
CHUNK_BYTES = 16_384


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema  # noqa: B018 - reads the footer only
        return True
    except AnalysisException:
        return False


def cache(
    spark: SparkSession,
    spec: DatasetSpec,
    cache_dir: str,
    fetch: Callable[[DatasetSpec], DataFrame],
    force: bool = False,
) -> str:
    """Write a validated, downcast dataset once; raises when validation fails."""
    path = f"{cache_dir}/{spec.name}"
    if not force and _exists(spark, path):
        return path
    df = nan_to_null(fetch(spec))
    report = validate(spec, df).first()
    if not report["ok"]:
        raise ValueError(f"{spec.name}: {'; '.join(report['errors'])}")
    downcast(df).write.mode("overwrite").parquet(path)
    record_checksums(spark, spec.name, path, f"{cache_dir}/_manifest")
    return path


def download(
    spark: SparkSession,
    specs: Iterable[DatasetSpec],
    cache_dir: str,
    fetch: Callable[[DatasetSpec], DataFrame],
    names: Iterable[str] | None = None,
    include_large: bool = False,
    force: bool = False,
) -> DataFrame:
    """Cache several datasets; without names all but the large tier. Outcome rows."""
    names = set(names) if names is not None else None
    rows = []
    for spec in specs:
        if names is not None and spec.name not in names:
            continue
        if names is None and not include_large and spec.tier == "large":
            continue
        try:
            rows.append((spec.name, "cached", cache(spark, spec, cache_dir, fetch, force)))
        except Exception as error:  # noqa: BLE001 - a failure is an outcome row
            rows.append((spec.name, "failed", str(error)[:300]))
    return spark.createDataFrame(rows, "dataset string, status string, detail string")


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines (path, size, start, line) of pieces of files as chunks of whole lines, each line ended, in their order."""
    seq = 0
    for batch in batches:
        path, size, start, line = batch.columns
        n = batch.num_rows
        if not n:
            continue
        ends = np.frombuffer(line.buffers()[1], dtype=np.int32)[line.offset : line.offset + n + 1]
        after = ends[1:].astype(np.int64) - ends[0] + np.arange(1, n + 1)
        held = np.full(after[-1], ord("\n"), dtype=np.uint8)
        if ends[-1] > ends[0]:
            own = np.ones(len(held), dtype=bool)
            own[after - 1] = False
            held[own] = np.frombuffer(line.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
        name, at = path.dictionary_encode().indices.to_numpy(), start.to_numpy()
        # A chunk ends with its piece of a file, or with the line that fills it.
        last = (np.diff(name) != 0) | (np.diff(at) != 0) | (np.diff(after // CHUNK_BYTES) != 0)
        rows = np.append(np.flatnonzero(last), n - 1)
        chunks = [held[a:b].tobytes() for a, b in zip(np.append(0, after[rows[:-1]]), after[rows])]
        picked = pa.array(rows)
        order = pa.array(np.arange(seq, seq + len(rows)))
        seq += len(rows)
        yield pa.RecordBatch.from_arrays([path.take(picked), size.take(picked), start.take(picked), order, pa.array(chunks, pa.binary())], ["path", "size", "start", "seq", "chunk"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, sha256) of files whose chunks come in order; a chunk's last line end is hashed when another byte follows."""
    path, size, read, digest = None, 0, 0, hashlib.sha256()

    def ended() -> pa.RecordBatch:
        if read == size:
            digest.update(b"\n")
        elif read != size + 1:
            raise ValueError(f"{path}: {read} bytes were read of {size}")
        return pa.RecordBatch.from_pydict({"path": [path], "sha256": [digest.hexdigest()]})

    for batch in batches:
        for name, total, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            bytes_ = memoryview(chunk.as_buffer())
            if name != path:
                if path is not None:
                    yield ended()
                path, size, read, digest = name, total, 0, hashlib.sha256()
            elif read:
                digest.update(b"\n")
            digest.update(bytes_[:-1])
            read += len(bytes_)
    if path is not None:
        yield ended()


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """sha256 per part file of a cached folder.

    No file is held whole, so they may be of any size: tasks read pieces of files as lines, which the text reader leaves
    as the bytes they are, and pack them into chunks; a file's chunks are sorted and hashed one after the other.
    """
    found = {"recursiveFileLookup": True, "pathGlobFilter": "*.parquet"}
    files = spark.read.format("binaryFile").options(**found).load(path)
    # Nothing but names and lengths is read here; Spark's readers list no empty files.
    listed = files.select(F.col("_metadata.file_path").alias("path"), F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    lines = spark.read.format("text").options(**found, lineSep="\n").load(path)
    pieces = lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    chunks = pieces.mapInArrow(_chunked, "path string, size long, start long, seq long, chunk binary")
    in_order = chunks.repartition("path").sortWithinPartitions("path", "start", "seq")
    digests = in_order.select("path", "size", "chunk").mapInArrow(_digested, "path string, sha256 string")
    unread = F.raise_error(F.concat(F.lit("no bytes were read of "), F.col("path"))).cast("string")
    return listed.join(digests, "path", "left").select("file", "length", F.coalesce("sha256", unread).alias("sha256"))


def record_checksums(spark: SparkSession, name: str, path: str, manifest: str) -> None:
    checksums(spark, path).withColumn("dataset", F.lit(name)).write.mode("overwrite").parquet(
        f"{manifest}/{name}"
    )


def verify_checksum(spark: SparkSession, name: str, cache_dir: str) -> bool:
    """True when every recorded part file is present and unchanged."""
    manifest, path = f"{cache_dir}/_manifest/{name}", f"{cache_dir}/{name}"
    if not (_exists(spark, manifest) and _exists(spark, path)):
        return False
    recorded = spark.read.parquet(manifest).select("file", F.col("sha256").alias("recorded"))
    now = checksums(spark, path).select("file", "sha256")
    differs = recorded.join(now, "file", "full_outer").filter(
        ~F.col("recorded").eqNullSafe(F.col("sha256"))
    )
    return differs.isEmpty()


def content_fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive fingerprint: rows, summed and xor-ed row hashes."""
    row_hash = F.xxhash64(*sorted(df.columns))
    return df.select(row_hash.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
        F.bit_xor("h").alias("hash_xor"),
    )
