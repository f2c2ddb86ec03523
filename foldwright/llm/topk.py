"""Exact top-k inner products by aggregation of sorted lists without random access.

The rows are dealt into blocks. In a block every dimension has one list of its values in order, which a query reads
from the top where its own component is positive and from the bottom where it is negative. All lists are read in
step. After each step a row's score has a lower and an upper bound: what was read of it, plus the least or the most
that its unread components can give, by the ends of the lists and by how far they were read. A query stops as soon
as no row outside its k best lower bounds can reach them; the scores of the rows that are left are then completed.
Bounds of all of a block's queries are kept as matrices, so a step is a few matrix products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.session import ship_package

BLOCK_ROWS = 2048
QUERY_ROWS = 1024
#: Share of the lists that has been read after each step.
STEPS = (1 / 32, 1 / 8, 1 / 4, 1 / 2, 1.0)
#: Largest integer up to which sums of products are exact in double precision.
EXACT = 1 << 53


def quantized(vector: str = "embedding", factor: int = 1024) -> Column:
    """floor(factor * x) of each component as long; null if the vector or a component is null or not finite."""
    values = F.transform(F.col(vector), lambda x: x.cast("double") * factor)
    sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(1 << 62))))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(values, lambda x: F.floor(x)))


def no_random_access(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) positions that hold every query's k best rows among ``rows``, a few more where the search ended.

    own are the queries' ids and ids those of the rows; a row of a query's own id is no candidate.
    """
    n, dims = rows.shape
    kind = np.float64 if n == 0 or dims * float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) < EXACT else np.int64
    q, x = queries.astype(kind), rows.astype(kind)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    order = np.argsort(x, axis=0, kind="stable")
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.arange(n)[:, None], axis=0)
    ends = np.take_along_axis(x, order, axis=0)
    least, most = ends[0], ends[-1]
    live_rows, live = np.arange(n), np.arange(len(q))
    out_query, out_row = [], []
    for share in STEPS:
        depth = max(1, int(np.ceil(n * share)))
        # what the lists have shown: the depth largest and the depth smallest values of each dimension
        top, bottom = ranks[live_rows] >= n - depth, ranks[live_rows] < depth
        front_top, front_bottom = ends[n - depth], ends[depth - 1]
        seen = x[live_rows]
        upper = up[live] @ np.where(top, seen, front_top).T + down[live] @ np.where(bottom, seen, front_bottom).T
        lower = up[live] @ np.where(top, seen, least).T + down[live] @ np.where(bottom, seen, most).T
        foreign = own[live][:, None] != ids[live_rows][None, :]
        floor = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        lower = np.where(foreign, lower, floor)
        if len(live_rows) > k:
            bar = np.partition(lower, len(live_rows) - k, axis=1)[:, len(live_rows) - k]
        else:
            bar = np.full(len(live), floor)
        possible = foreign & (upper >= bar[:, None])
        few = possible.sum(axis=1) <= 2 * k
        if share >= 1.0:
            few[:] = True
        at_query, at_row = np.nonzero(possible & few[:, None])
        out_query.append(live[at_query])
        out_row.append(live_rows[at_row])
        live_rows = live_rows[possible[~few].any(axis=0)]
        live = live[~few]
        if len(live) == 0 or len(live_rows) == 0:
            break
    return np.concatenate(out_query), np.concatenate(out_row)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def _search(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query", "query_id", "vec_id", "score"]
        if queries.num_rows == 0 or rows.num_rows == 0:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        q, x = _matrix(queries["vector"], queries.num_rows), _matrix(rows["vector"], rows.num_rows)
        own, ids = queries["query_id"].to_numpy(), rows["vec_id"].to_numpy()
        at_query, at_row = no_random_access(q, own, x, ids, k)
        score = np.einsum("ij,ij->i", q[at_query], x[at_row])
        order = np.lexsort((ids[at_row], -score, at_query))
        at_query, at_row, score = at_query[order], at_row[order], score[order]
        place = np.arange(len(at_query)) - np.searchsorted(at_query, at_query)
        best = place < k
        return pa.table([queries["query"].to_numpy()[at_query[best]], own[at_query[best]], ids[at_row[best]], score[best]], names=names)

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query, ties to smaller vec_id.

    vectors(vec_id long, vector array<long>), queries(query_id long, vector array<long>). Every row of vectors is a
    candidate but those of the query's own id. Null vectors and rows with a null id take no part, and only vectors of
    equal length meet. Repeated rows of vectors count each; equal rows of queries are asked once, different vectors
    of one query_id each. Fewer candidates than k give all. Empty tables give no rows.

    Queries and rows meet in blocks of query_rows and block_rows, so a task holds no more than one of each.
    """
    ship_package(vectors.sparkSession)
    sound = vectors.where("vec_id is not null and vector is not null").select("vec_id", "vector", F.size("vector").alias("dims"))
    asked = queries.where("query_id is not null and vector is not null").distinct().withColumn("dims", F.size("vector"))
    asked = asked.withColumn("query", F.xxhash64("query_id", "vector"))
    blocks, parts = max(1, -(-sound.count() // block_rows)), max(1, -(-asked.count() // query_rows))
    spread = F.xxhash64("vec_id", F.monotonically_increasing_id())
    rows = sound.withColumn("block", F.pmod(spread, F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    wanted = asked.withColumn("part", F.pmod(F.col("query"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    left = wanted.select("dims", "part", "block", "query", "query_id", "vector").groupBy("dims", "part", "block")
    right = rows.select(F.col("dims").alias("size"), F.col("part").alias("group"), F.col("block").alias("piece"), "vec_id", "vector").groupBy("size", "group", "piece")
    found = left.cogroup(right).applyInArrow(_search(k), "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
