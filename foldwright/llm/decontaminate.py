"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

A short item inside a long text has a tiny Jaccard similarity with it, so one MinHash of the whole text would miss
it. Items are therefore partitioned by their number of distinct shingles, each partition with an upper size u (a
power of two), and for each partition a text is searched in windows of 2u shingles, u apart: every run of u
shingles lies in a window, whose similarity with a contained item is bounded from below by the partition's size.
A signature is a one-permutation MinHash: the smallest shingle hash in each of BINS_PER_SHINGLE * u bins. An item and
a text that agree in any bin of any window are a candidate; candidates are verified by exact containment.

With 8u bins a window's bin holds 1/4 shingle on average, so an item's minimum is also the window's with a
probability near 0.9, and an item of 9 shingles of which 80 % are present is missed with a probability below 1e-6.
Items of up to 8 shingles get 65,536 bins, as one shingle may have to suffice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm import words as W
from foldwright.llm.rows import text_hash
from foldwright.session import cut_lineage, ship_package

CONTAINMENT = 0.8
SMALLEST = 8
BINS_PER_SHINGLE = 8
SMALLEST_BINS = 65_536
#: Bits of the filter that tasks get of all items' shingles: 8 MB, whatever the number of items. Hits by chance cost
#: candidate rows, never results.
FILTER_BITS = 1 << 26


def size_class(shingle_count: np.ndarray) -> np.ndarray:
    """Upper size of the partition that items of so many shingles belong to."""
    return np.maximum(SMALLEST, 1 << np.ceil(np.log2(np.maximum(shingle_count, 1))).astype(np.int64))


def bins(upper: int) -> int:
    return SMALLEST_BINS if upper == SMALLEST else BINS_PER_SHINGLE * upper


def _minima(owner: np.ndarray, hashes: np.ndarray, upper: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, entry, shingle): each owner's smallest hash of each bin; entry identifies partition, bin and hash."""
    scattered = W.mix(hashes ^ np.uint64(upper))
    spot = (scattered % np.uint64(bins(upper))).astype(np.int64)
    rank = scattered // np.uint64(bins(upper))
    order = np.lexsort((rank, spot, owner))
    owner, spot, hashes, scattered = owner[order], spot[order], hashes[order], scattered[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (spot[1:] != spot[:-1])
    return owner[first], W.mix(scattered[first] + np.uint64(upper)), hashes[first]


def _lists(owner: np.ndarray, values: np.ndarray, count: int) -> pa.ListArray:
    """Values grouped by owner (in order of owner) as one list for each of ``count`` owners."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(count + 1)).astype(np.int32)), pa.array(values.view(np.int64)))


def _item_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, doc, words in W.word_hashes(batch.column("text").to_pylist()):
                n = last - first
                d, h, _ = W.distinct_counts(*W.shingles(doc, words, size))
                upper = size_class(np.bincount(d, minlength=n))
                found = [_minima(d[upper[d] == u], h[upper[d] == u], int(u))[:2] for u in np.unique(upper)]
                owner, entry = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                order = np.argsort(owner, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").slice(first, n), batch.column("item").slice(first, n), pa.array(upper), _lists(owner[order], entry[order], n), _lists(d, h, n)],
                    names=["item_id", "item", "upper", "entries", "shingles"],
                )

    return run


def _document_batches(size: int, uppers: list[int], known: Broadcast, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            for first, last, doc, words in W.word_hashes(batch.column("text").to_pylist()):
                n = last - first
                doc, h = W.shingles(doc, words, size)
                spot = h & np.uint64(bits - 1)
                hit = ((table[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1)).astype(bool)
                if not hit.any():
                    continue
                starts = np.searchsorted(doc, np.arange(n))
                place = np.arange(len(doc)) - starts[doc]
                owners = []
                at = np.tile(np.arange(len(doc)), 2)
                for u in uppers:
                    # window w of a text holds its blocks w and w + 1, so block k is in windows k and k - 1
                    block = place // u
                    window = doc[at] * np.int64(1 << 32) + np.concatenate([block, np.maximum(block - 1, 0)])
                    useful = np.isin(window, window[hit[at]])
                    w, low, shingle = _minima(window[useful], h[at[useful]], u)
                    owners.append((w >> np.int64(32), low, shingle))
                owner, entry, shingle = (np.concatenate([x[k] for x in owners]) for k in range(3))
                spot = shingle & np.uint64(bits - 1)
                passed = ((table[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1)).astype(bool)
                owner, entry, _ = W.distinct_counts(owner[passed], entry[passed])
                d, shared, _ = W.distinct_counts(doc[hit], h[hit])
                found = pa.array(np.unique(owner))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, n).take(found),
                        batch.column("th").slice(first, n).take(found),
                        _lists(owner, entry, n).take(found),
                        _lists(d, shared, n).take(found),
                    ],
                    names=["doc_id", "th", "entries", "shared"],
                )

    return run


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, shingle_words: int = W.SHINGLE_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, th, item_id, containment, shared, item_shingles): items(item_id, text) inside docs(doc_id, text).

    containment is the share of the item's distinct word shingles that the whole text has, threshold or more. An item
    of fewer words than a shingle is one shingle of all its words, and the documents' shingles of so many words are
    looked through for it, in a pass for each such length that occurs.
    Repeated rows of a document (same doc_id and text) or of an item give one row. Null texts and texts without
    words are never contained in anything and contain nothing. Null ids are kept as null. Texts may have any length.
    Other columns are ignored; an empty table on either side gives no rows.
    """
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    counted = cut_lineage(items.where("text is not null").select("item_id", "text", F.least(words, F.lit(shingle_words)).alias("words")))
    lengths = sorted(r["words"] for r in counted.where("words > 0").select("words").distinct().collect())
    found = None
    for size in lengths or [shingle_words]:
        one = _contained(docs, counted.where(F.col("words") == size).drop("words"), threshold, size, filter_bits)
        found = one if found is None else found.unionByName(one)
    return found


def _contained(docs: DataFrame, items: DataFrame, threshold: float, shingle_words: int, filter_bits: int) -> DataFrame:
    """contained_items for items of at least as many words as a shingle."""
    spark = ship_package(docs.sparkSession)
    listed = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    listed = listed.withColumn("item", F.xxhash64("item_id", "text"))
    listed = listed.mapInArrow(_item_batches(shingle_words), "item_id long, item long, upper long, entries array<long>, shingles array<long>")
    listed = cut_lineage(listed.where(F.size("shingles") > 0))
    uppers = [r.upper for r in listed.select("upper").distinct().collect()]  # powers of two: a few dozen at most
    spots = listed.select(F.explode("shingles").alias("hash")).select(F.expr(f"hash & {filter_bits - 1}L").alias("spot"))
    filled = spots.groupBy(F.expr("shiftright(spot, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(filter_bits // 64, np.uint64)
    table[filled.column("word").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    known = spark.sparkContext.broadcast(table)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), "text").where("text is not null")
    found = rows.mapInArrow(_document_batches(shingle_words, sorted(uppers), known, filter_bits), "doc_id long, th long, entries array<long>, shared array<long>")
    found = cut_lineage(found.dropDuplicates(["doc_id", "th"]).withColumn("doc", F.xxhash64("doc_id", "th")))
    entries = listed.select(F.explode("entries").alias("entry"), "item")
    pairs = found.select("doc", F.explode("entries").alias("entry")).join(entries, "entry").select("doc", "item").distinct()
    sized = listed.select("item_id", "item", "shingles")
    checked = pairs.join(found.select("doc", "doc_id", "th", "shared"), "doc").join(sized, "item")
    checked = checked.withColumn("shared", F.size(F.array_intersect("shingles", "shared"))).withColumn("item_shingles", F.size("shingles"))
    checked = checked.withColumn("containment", F.col("shared") / F.col("item_shingles"))
    return checked.where(F.col("containment") >= threshold).select("doc_id", "th", "item_id", "containment", "shared", "item_shingles")


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs that contain no item; null texts stay, and all copies of a contaminated document go."""
    bad = cut_lineage(contained_items(docs, items, **options).select(F.col("doc_id").alias("__doc_id"), F.col("th").alias("__th")).distinct())
    test = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id")) & text_hash().eqNullSafe(F.col("__th"))
    return docs.join(bad, test, "left_anti")
