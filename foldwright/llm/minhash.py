"""Near duplicates by ProbMinHash signatures of weighted word shingles, banding and exact verification.

Each shingle of a text starts a Poisson process whose rate is its number of occurrences; every arrival falls into
one of the signature's registers, and a register keeps the shingle that arrived first. Two texts agree in a register
with a probability equal to their probability Jaccard similarity, a scale-free similarity of weighted sets that
equals the Jaccard similarity when all weights are one. The process of a shingle ends as soon as its next arrival is
later than the latest register, so a text costs about (shingles + registers * log(registers)) arrivals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm import words as W
from foldwright.llm.groups import block_nodes, link_groups, settled, shared_keys, width
from foldwright.llm.rows import key_filter, null_safe, text_hash, with_maybe
from foldwright.session import cut_lineage, ship_package

REGISTERS = 256
BAND_ROWS = 8
SIMILARITY = 0.8
#: The lowest bits of two texts' registers differ in a share of (1 - J) / 2 on average; pairs that differ in more
#: than so many standard deviations above that are not compared. Of links of just the threshold 3 in a million do.
DEVIATIONS = 4.5
FEATURE_ROWS = 4_000


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (texts, registers): the element that arrives first in each register."""
    time = np.full(texts * registers, np.inf)
    holder = np.zeros(texts * registers, np.uint64)
    latest = np.full(texts, np.inf)
    clock = np.zeros(len(element))
    step = 0
    while len(element):
        step += 1
        draw = W.mix(element + np.uint64((step * 0xA0761D6478BD642F) % (1 << 64)))
        wait = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        clock = clock + wait / weight
        alive = clock < latest[doc]
        doc, element, weight, clock, draw = doc[alive], element[alive], weight[alive], clock[alive], draw[alive]
        place = doc * registers + (W.mix(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(time, place, clock)
        won = time[place] == clock
        holder[place[won]] = element[won]
        active = np.unique(doc)
        latest[active] = time.reshape(texts, registers)[active].max(axis=1)
    return holder.reshape(texts, registers)


def probability_jaccard(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two weighted sets (sorted elements, weights)."""
    if len(left[0]) == 0 or len(right[0]) == 0:
        return 0.0
    common, i, j = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
    if len(common) == 0:
        return 0.0
    x, y = left[1][i], right[1][j]
    rest_x, rest_y = left[1].sum() - x.sum(), right[1].sum() - y.sum()
    if len(common) and (x == x[0]).all() and (y == y[0]).all():
        # all shared weights agree up to a factor: every shared element has the same bound
        ratio_x, ratio_y = rest_x / x[0], rest_y / y[0]
        return float(len(common) / (len(common) + ratio_x + ratio_y))
    order = np.argsort(x / y)
    x, y = x[order], y[order]
    # sum over shared j of max(x_j / x_i, y_j / y_i): by the order of x_j / y_j one side is the larger for a prefix
    before_y = np.concatenate([[0.0], np.cumsum(y)[:-1]])
    from_x = x.sum() - np.concatenate([[0.0], np.cumsum(x)[:-1]])
    total = before_y / y + from_x / x + rest_x / x + rest_y / y
    return float((1.0 / total).sum())


def _signature_batches(registers: int, band_rows: int, size: int):
    bands = registers // band_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, last, doc, words in W.word_hashes(texts):
                count = last - first
                node = W.sequence_hash(doc, words, count)
                d, element, times = W.distinct_counts(*W.shingles(doc, words, size))
                held = prob_minhash(d, element, times.astype(np.float64), count, registers)
                keys = np.zeros((count, bands), np.uint64)
                for r in range(band_rows):
                    keys = W.mix(keys ^ held[:, r * bands : (r + 1) * bands])
                keys = W.mix(keys + np.arange(bands, dtype=np.uint64))
                bits = np.packbits((held & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                known = node != 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, count),
                        batch.column("th").slice(first, count),
                        pa.array(node.view(np.int64), mask=~known),
                        pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64())),
                        pa.FixedSizeListArray.from_arrays(pa.array(bits.ravel()), registers // 64).cast(pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "th", "node", "bands", "bits"],
                )

    return run


def _shingle_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, doc, words in W.word_hashes(batch.column("text").to_pylist()):
                d, element, times = W.distinct_counts(*W.shingles(doc, words, size))
                offsets = pa.array(np.searchsorted(d, np.arange(last - first + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node").slice(first, last - first),
                        pa.ListArray.from_arrays(offsets, pa.array(element.view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
                    ],
                    names=["node", "elements", "times"],
                )

    return run


def _weighted_sets(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(elements, occurrences) of each row."""
    sets = []
    for chunk in table.to_batches():
        elements, times = chunk.column("elements"), chunk.column("times")
        low, counts = elements.flatten().to_numpy().view(np.uint64), times.flatten().to_numpy().astype(np.float64)
        sizes = elements.value_lengths().to_numpy()
        sets += [(low[end - size : end], counts[end - size : end]) for end, size in zip(np.cumsum(sizes), sizes, strict=True)]
    return sets


def _block_links(threshold: float):
    def run(pairs: pa.Table, features: pa.Table) -> pa.Table:
        """The links among the pairs of two blocks; features has each node of them once."""
        sets = dict(zip(features["node"].to_pylist(), _weighted_sets(features), strict=True))
        keep = [probability_jaccard(sets[a], sets[b]) >= threshold - 1e-12 for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True)]
        return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _search_blocks(threshold: float, most_bits: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The links between the nodes of two blocks that are of different components."""
        nodes, comps, bits, sets = [], [], [], []
        for side in (left, right.rename_columns([c.removeprefix("other_") for c in right.column_names])):
            nodes.append(side["node"].to_numpy())
            comps.append(side["comp"].to_numpy())
            bits.append(np.stack([side[c].to_numpy() for c in side.column_names if c.startswith("bits")], axis=1))
            sets.append(_weighted_sets(side))
        found = []
        for i, node in enumerate(nodes[0]):
            differ = np.bitwise_count(bits[1] ^ bits[0][i]).sum(axis=1)
            for j in np.flatnonzero((differ <= most_bits) & (comps[1] != comps[0][i])):
                if probability_jaccard(sets[0][i], sets[1][j]) >= threshold - 1e-12:
                    found.append((node, nodes[1][j]))
        a, b = (np.array([f[k] for f in found], np.int64) for k in range(2))
        return pa.table([np.minimum(a, b), np.maximum(a, b)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, registers: int = REGISTERS, band_rows: int = BAND_ROWS, threshold: float = SIMILARITY, shingle_words: int = W.SHINGLE_WORDS) -> DataFrame:
    """(doc_id, th, class_key, class_id, class_size), one row per row of docs(doc_id, text, ...).

    class_id is the smallest doc_id of the row's group of near duplicates (null if all are null), class_key its
    internal key, th the hash of the text. Texts of the same words are one node, whatever their case and
    punctuation; nodes are linked if the probability Jaccard similarity of their shingles is at least threshold.
    Texts of fewer words than a shingle have one shingle. A null text, or one without letters and digits, is alone:
    its class_key is null and class_id its own doc_id. Repeated rows are members like any other copy. Other columns
    are ignored. An empty table gives no rows.
    """
    spark = ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), "text")
    bits = registers // 64
    apart = (1 - threshold) / 2
    most_bits = int(registers * apart + DEVIATIONS * np.sqrt(registers * apart * (1 - apart))) + 1
    signed = cut_lineage(
        rows.mapInArrow(_signature_batches(registers, band_rows, shingle_words), "doc_id long, th long, node long, bands array<long>, bits array<long>")
    )
    nodes = signed.where("node is not null").groupBy("node").agg(F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    spread = nodes.select("node", F.explode("bands").alias("key"), *[F.col("bits")[i].alias(f"bits{i}") for i in range(bits)])
    members = shared_keys(spread)
    chosen = signed.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("row"))
    chosen = chosen.join(members.select("node").distinct(), "node", "left_semi").select("node", "row.doc_id", "row.th")
    kept = rows.where("text is not null")
    # a bounded filter keeps most texts that are no candidates from being shuffled
    chosen = settled(chosen)
    kept = with_maybe(kept, F.xxhash64("doc_id", "th"), key_filter(chosen.select(F.xxhash64("doc_id", "th").alias("key")))).where("__maybe")
    texts = kept.join(chosen, null_safe(kept, chosen, ["doc_id", "th"])).select("node", "text")
    features = settled(texts.mapInArrow(_shingle_batches(shingle_words), "node long, elements array<long>, times array<int>").dropDuplicates(["node"]), FEATURE_ROWS)

    def verify(pairs: DataFrame) -> DataFrame:
        few = max(width(pairs), width(features))
        # a node's shingles travel once to each pair of blocks that it has pairs in, not once for each pair
        keys = ["block_a", "block_b"]
        needed = pairs.select(*keys, F.col("a").alias("node")).union(pairs.select(*keys, F.col("b").alias("node"))).distinct()
        sets = needed.coalesce(few).toDF("low_block", "high_block", "node").join(features, "node").coalesce(few)
        return pairs.groupBy(*keys).cogroup(sets.groupBy("low_block", "high_block")).applyInArrow(_block_links(threshold), "a long, b long")

    def near(left: str, right: str):
        differ = sum(F.bit_count(F.col(f"{left}.bits{i}").bitwiseXOR(F.col(f"{right}.bits{i}"))) for i in range(bits))
        return differ <= most_bits

    def search(live: DataFrame) -> DataFrame:
        # nodes meet block by block, so a large group's last pairs are compared in tasks and never become rows
        near_side, far_side = block_nodes(live)
        columns = ["node", "comp", *[f"bits{i}" for i in range(bits)]]
        nodes = live.select(*columns).distinct().join(features, "node")
        left = near_side.join(nodes, "node")
        others = nodes.toDF(*[f"other_{c}" for c in nodes.columns])
        right = far_side.toDF("low_block", "high_block", "at").join(others, F.col("at") == F.col("other_node"))
        found = left.groupBy("block_a", "block_b").cogroup(right.groupBy("low_block", "high_block"))
        return found.applyInArrow(_search_blocks(threshold, most_bits), "a long, b long")

    comps = link_groups(members, verify, near, search)
    narrow = signed.select("doc_id", "th", "node")
    classed = cut_lineage(narrow.join(comps, "node", "left").withColumn("class_key", F.coalesce("comp", "node")).select("doc_id", "th", "class_key"))
    sizes = classed.where("class_key is not null").groupBy("class_key").agg(F.min("doc_id").alias("low"), F.count("*").alias("size"))
    out = classed.join(sizes, "class_key", "left")
    alone = F.col("class_key").isNull()
    return out.select(
        "doc_id", "th", "class_key", F.when(alone, F.col("doc_id")).otherwise(F.col("low")).alias("class_id"), F.coalesce("size", F.lit(1)).cast("long").alias("class_size")
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, one of each group: the one of smallest doc_id (null last), then of smallest text hash.

    Of repeated rows with the same doc_id and text one stays. Null texts and texts without words all stay.
    """
    classed = cut_lineage(near_duplicates(docs, **options))
    keep = classed.where("class_key is not null").groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("row"))
    keep = keep.select(F.col("row.doc_id").alias("__doc_id"), F.col("row.th").alias("__th"))
    alone = classed.where("class_key is null").select(F.col("doc_id").alias("__doc_id"), F.col("th").alias("__th")).distinct()
    marked = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__text": text_hash()})
    match = marked["__doc"].eqNullSafe(F.col("__doc_id")) & marked["__text"].eqNullSafe(F.col("__th"))
    wordy = marked.join(keep, match, "left_semi").dropDuplicates(["__doc", "__text"])
    return wordy.unionByName(marked.join(alone, match, "left_semi")).drop("__doc", "__text")
