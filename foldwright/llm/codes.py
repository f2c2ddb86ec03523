"""Vector code compression: product codes whose nearest entries are found with a GNAT over each codebook.

Vectors of integers are cut into equal parts; every part gets the number of its codebook's nearest entry. Codebooks
start as the parts of the first vectors and are moved by a fixed number of rounds to the means of their parts. A round
is one pass over the table: tasks add up the parts of each entry, Spark adds up the tasks, and the driver holds one
codebook of fixed size.

The search tree (geometric near-neighbour access tree) of a codebook: a node has split points chosen far apart, every
other entry belongs to its nearest split point, and for every two split points the node stores the range of distances
from the one to the entries of the other. A query's distances to the split points, together with the best distance so
far, exclude whole subtrees. Distances are rounded outwards and exclusion is strict, so an entry at exactly the best
distance is always looked at; what is looked at is compared by integer squared distance, ties by the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.session import cut_lineage, ship_package

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Split points of a node, and entries below which a node has none.
DEGREE, LEAF = 12, 8
#: Relative width by which a distance is rounded outwards; that of a double is 2**-53.
OUTWARDS = 2.0**-49
#: Tables of up to so many labels are broadcast, larger ones joined.
BROADCAST_LABELS = 50_000
_FAR = int(np.iinfo(np.int64).max)


def largest(dims: int) -> int:
    """Components are kept within this, so that a squared distance of ``dims`` of them is below 2**62."""
    return 1 << (60 - dims.bit_length()) // 2


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances between the rows of two integer arrays."""
    most = max((int(np.abs(x).max(initial=0)) for x in (a, b)), default=0)
    if 4 * a.shape[1] * most * most < 1 << 53:  # every sum is exact in doubles
        product = (a.astype(float) @ b.astype(float).T).astype(np.int64)
    else:
        product = a @ b.T
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * product


def _rounded(squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A lower and an upper bound of the distances."""
    root = np.sqrt(squared.astype(float))
    return root * (1 - OUTWARDS), root * (1 + OUTWARDS)


class Gnat:
    """The tree over the rows of ``entries``; of equal rows only the first can be an answer."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE, leaf: int = LEAF):
        self.entries, self.degree, self.leaf = np.ascontiguousarray(entries, np.int64), max(2, degree), max(1, leaf)
        _, first = np.unique(self.entries, axis=0, return_index=True) if len(self.entries) else (None, np.zeros(0, np.int64))
        self.compared = 0
        self.root = self._node(np.sort(first))

    def _node(self, numbers: np.ndarray):
        """numbers alone for a leaf, else (split numbers, low, high, children)."""
        if len(numbers) <= max(self.leaf, 2):
            return numbers
        rows = self.entries[numbers]
        chosen, near = [0], squared_distances(rows, rows[:1])[:, 0]
        while len(chosen) < min(self.degree, len(numbers)):
            chosen.append(int(near.argmax()))
            near = np.minimum(near, squared_distances(rows, rows[chosen[-1:]])[:, 0])
        chosen = np.sort(chosen)
        apart = squared_distances(rows, rows[chosen])
        owner = apart.argmin(1)
        owner[chosen] = np.arange(len(chosen))
        low, high = _rounded(apart)
        low = np.stack([low[owner == j].min(0) for j in range(len(chosen))], 1)
        high = np.stack([high[owner == j].max(0) for j in range(len(chosen))], 1)
        rest = np.setdiff1d(np.arange(len(numbers)), chosen)
        return numbers[chosen], low, high, [self._node(numbers[rest[owner[rest] == j]]) for j in range(len(chosen))]

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each query's nearest entry, ties to the smaller number."""
        found = np.full(len(queries), len(self.entries)), np.full(len(queries), _FAR)
        if len(queries) and len(self.entries):
            self._visit(self.root, queries, np.arange(len(queries)), *found)
        return found

    def _look(self, numbers: np.ndarray, queries: np.ndarray, rows: np.ndarray, number: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Squared distances of the queries to the entries; the best ones so far are updated."""
        apart = squared_distances(queries[rows], self.entries[numbers])
        self.compared += apart.size
        at = apart.argmin(1)  # the first of equals, and numbers ascend
        least, which = apart[np.arange(len(rows)), at], numbers[at]
        better = (least < best[rows]) | ((least == best[rows]) & (which < number[rows]))
        best[rows[better]], number[rows[better]] = least[better], which[better]
        return apart

    def _visit(self, node, queries, rows, number, best) -> None:
        if not isinstance(node, tuple):
            if len(node):
                self._look(node, queries, rows, number, best)
            return
        splits, low, high, children = node
        apart = self._look(splits, queries, rows, number, best)
        down, up = _rounded(apart)
        own = apart.argmin(1)
        for j, child in enumerate(children):  # the nearest split point's entries first, as they shorten the best distance
            if len(child):
                here = own == j
                if here.any():
                    self._visit(child, queries, rows[here], number, best)
        for j, child in enumerate(children):
            if len(child):
                rest = np.flatnonzero(own != j)
                reach = _rounded(best[rows[rest]])[1][:, None]
                beyond = (down[rest] - reach > high[:, j]) | (up[rest] + reach < low[:, j])
                rest = rest[~beyond.any(1)]
                if len(rest):
                    self._visit(child, queries, rows[rest], number, best)


def _cut(vectors: np.ndarray, parts: int) -> np.ndarray:
    """(parts, rows, width) of (rows, dims); where dims is no multiple of parts, zeros fill the last parts."""
    width = -(-vectors.shape[1] // parts)
    padded = np.zeros((len(vectors), width * parts), np.int64)
    padded[:, : vectors.shape[1]] = vectors
    return padded.reshape(len(vectors), parts, width).transpose(1, 0, 2)


@dataclass
class Codebooks:
    """books[part, entry, position] for vectors of ``dims`` components."""

    books: np.ndarray
    dims: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def quantized(column: str = "embedding", scale: int = SCALE) -> Column:
    """floor(scale * x) of each component of an array column; null if it is null or has null or non-finite components."""
    whole = F.col(column).cast("array<double>")
    finite = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    limit = float(1 << 62)
    return F.when(finite, F.transform(whole, lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(x * scale).cast("double"))).cast("long")))


def _kept(vectors: DataFrame, dims: int) -> DataFrame:
    most = largest(dims)
    inside = F.transform("vector", lambda x: F.greatest(F.lit(-most).cast("long"), F.least(F.lit(most).cast("long"), x)))
    return vectors.where(F.col("vector").isNotNull() & (F.size("vector") == dims)).withColumn("vector", inside)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _summed(trees, dims: int, parts: int, entries: int) -> callable:
    """For mapInArrow: (part, entry, count, sums) of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = -(-dims // parts)
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for part, rows in enumerate(_cut(_matrix(batch.column("vector"), dims), parts)):
                number, _ = trees.value[part].nearest(rows)
                np.add.at(sums[part], number, rows)
                counts[part] += np.bincount(number, minlength=entries)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            names=["part", "entry", "count", "sums"],
        )

    return run


def train_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of vectors(vec_id, vector array<long>), None if no row has a vector.

    They start as the parts of the ``entries`` rows with the smallest vec_id (null last, ties by the vector). A
    round gives each part of each row to its nearest entry and replaces every entry by the componentwise
    floor(sum / count) of its parts; unused entries stay. dims is the length of the first row's vector; rows of
    other lengths, and null vectors, take no part. Components beyond largest(dims) count as that. What goes to the
    driver is parts * entries rows a round.
    """
    spark = ship_package(vectors.sparkSession)
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    head = vectors.where("vector is not null").select("vec_id", "vector").orderBy(*order).first()
    if head is None:
        return None
    dims = len(head["vector"])
    kept = _kept(vectors.select("vec_id", "vector"), dims)
    first = [r["vector"] for r in kept.orderBy(*order).limit(entries).collect()]
    books = np.ascontiguousarray(_cut(np.array(first, np.int64).reshape(len(first), dims), parts))
    width = books.shape[2]
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([Gnat(book) for book in books])
        found = kept.select("vector").mapInArrow(_summed(trees, dims, parts, books.shape[1]), "part int, entry int, count long, sums array<long>")
        added = found.groupBy("part", "entry").agg(F.sum("count").alias("count"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
        for row in added.collect():
            books[row["part"], row["entry"]] = [row[f"s{i}"] // row["count"] for i in range(width)]
        trees.unpersist()
    return Codebooks(books, dims)


def _encoded(trees, dims: int, parts: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _cut(_matrix(batch.column("vector"), dims), parts)
            found = [tree.nearest(rows[part]) for part, tree in enumerate(trees.value)]
            digits = max(2, -(-(len(trees.value[0].entries) - 1).bit_length() // 4))
            names = np.array([f"{i:0{digits}x}" for i in range(len(trees.value[0].entries))])
            code = names[found[0][0]] if len(batch) else np.zeros(0, "U2")
            for number, _ in found[1:]:
                code = np.char.add(code, names[number])
            error = sum(apart for _, apart in found)
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "vector"]
            names_kept = [name for name in batch.schema.names if name != "vector"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(code.tolist(), pa.string()), pa.array(error, pa.int64())], names=[*names_kept, "code", "error"])

    return run


def encode(vectors: DataFrame, codebooks: Codebooks) -> DataFrame:
    """vectors without the column vector, and with code (the entries' numbers in hexadecimal, part after part) and error
    (the sum of the parts' squared distances). Null vectors and vectors of another length are left out; repeated
    rows give equal rows; existing columns code and error are replaced."""
    spark = ship_package(vectors.sparkSession)
    rows = _kept(vectors.drop("code", "error"), codebooks.dims)
    trees = spark.sparkContext.broadcast([Gnat(book) for book in codebooks.books])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "vector")
    return rows.mapInArrow(_encoded(trees, codebooks.dims, len(codebooks.books)), f"{schema}{', ' if schema else ''}code string, error long")


def decode(codes: DataFrame, codebooks: Codebooks) -> DataFrame:
    """codes(code, ...) with the column vector: the entries that a code names, one part after another."""
    parts, entries, width = codebooks.books.shape
    digits = max(2, -(-(entries - 1).bit_length() // 4))
    rows = [(part, f"{entry:0{digits}x}", codebooks.books[part, entry].tolist()) for part in range(parts) for entry in range(entries)]
    books = codes.sparkSession.createDataFrame(rows, "part int, name string, entry array<long>")
    for part in range(parts):
        side = books.where(F.col("part") == part).select(F.col("name").alias("__name"), F.col("entry").alias(f"__{part}"))
        codes = codes.withColumn("__name", F.substring("code", part * digits + 1, digits)).join(F.broadcast(side), "__name", "left").drop("__name")
    whole = F.slice(F.concat(*[F.col(f"__{part}") for part in range(parts)]), 1, max(codebooks.dims, 1))
    return codes.withColumn("vector", whole).drop(*[f"__{part}" for part in range(parts)])


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vectors(vec_id, label, vector array<long>) as vec_id, label, code, error, label_error and codebooks_sha256.

    See train_codebooks and encode. label_error is the error summed over the rows of the same label, nulls together
    (at most 2**63 - 1). Without any vector there are no rows.
    """
    rows = vectors.select("vec_id", "label", "vector")
    codebooks = train_codebooks(rows, parts, entries, rounds)
    if codebooks is None:
        empty = rows.where("false").select("vec_id", "label")
        return empty.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    done = cut_lineage(encode(rows, codebooks))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_FAR).cast("decimal(38,0)"))
    sums = cut_lineage(done.groupBy(F.col("label").alias("__label")).agg(total.cast("long").alias("label_error")))
    side = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    joined = done.join(side, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
    return joined.withColumn("codebooks_sha256", F.lit(codebooks.sha256()))
