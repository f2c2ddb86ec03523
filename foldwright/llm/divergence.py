"""Source divergence audit: which sources of a language use its words unlike the others, and by which words.

Counting (token-start pointer sort): a task lower-cases a slice of an Arrow text buffer, takes a pointer to every word
start, and sorts the pointers by multikey quicksort with eight bytes as a digit: a slice is sorted by the digit at its
depth, and each run of equal digits, if its words go on, is a slice of the next depth; all slices of a depth are
sorted at once. Equal runs are the terms; a run's documents and sources give the document frequency and the counts
by source. Words are never made into strings one by one, and Spark adds up what the slices found.

Report: with the counts of the terms that a language keeps, every source is compared with each other source (part
``pair``) and with its whole language (part ``term``) by integer shares p and q of a word: floor((p - q)^2 / q).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.session import cut_lineage, ship_package

LEAST_DOCS = 3
TOP = 200
#: Shares are counted in billionths.
SHARE = 1_000_000_000
#: Bytes of text whose pointers are sorted at once; a longer text is cut between words.
SLICE_BYTES = 4 << 20
#: Sources whose pairs are added up together, and numbers that a task holds for that.
BLOCK_SOURCES, CELLS = 1024, 1 << 22
#: Tables of up to so many sources are broadcast to the rows of terms, larger ones joined.
BROADCAST_SOURCES = 50_000

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Keeps the first n bytes of a digit.
_HEAD = np.array([0, *[((1 << 8 * n) - 1) << 8 * (8 - n) for n in range(1, 9)]], np.uint64)

_COUNTED = "lang string, source string, term string, docs long, count long"


def word_pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of every word in bytes cut into texts at the offsets, in order."""
    inside = _LETTER[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True  # no word goes on from one text to the next
    starts = inside & fresh[:-1]
    starts[1:] |= inside[1:] & ~inside[:-1]
    ends = inside & fresh[1:]
    ends[:-1] |= inside[:-1] & ~inside[1:]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1 - at, np.searchsorted(offsets, at, side="right") - 1


def pointer_sort(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the pointers' stable order by their words' bytes, and whether a run of equal words begins there."""
    digits = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    order, first = np.arange(len(starts)), np.zeros(len(starts), bool)
    first[:1] = True
    open_, depth = np.arange(len(starts)), 0
    while len(open_):
        pointers = order[open_]
        left = np.clip(lengths[pointers] - depth, 0, 8)
        place = np.minimum(starts[pointers] + depth, len(data))
        key = np.ascontiguousarray(digits[place]).view(">u8").ravel().astype(np.uint64) & _HEAD[left]
        piece = np.cumsum(first[open_])
        by = np.lexsort((key, piece)) if depth else np.argsort(key, kind="stable")
        order[open_], key, left = pointers[by], key[by], left[by]
        cut = np.ones(len(by), bool)
        cut[1:] = (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])
        first[open_[cut]] = True
        size = np.diff(np.append(np.flatnonzero(cut), len(cut)))
        open_ = open_[(np.repeat(size, size) > 1) & (left == 8)]
        depth += 8
    return order, first


def _strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The words at the pointers as an Arrow array."""
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    taken = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[taken].tobytes())])


def count_slice(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, documents, occurrences) of a slice of texts, group being a number for each text."""
    starts, lengths, text = word_pointers(data, offsets)
    order, first = pointer_sort(data, starts, lengths)
    if len(order) == 0:
        return pa.array([], pa.string()), *[np.zeros(0, np.int64)] * 3
    text, run = text[order], np.cumsum(first) - 1
    # within a run the pointers stand by text, so its texts are runs too
    fresh = first.copy()
    fresh[1:] |= text[1:] != text[:-1]
    at = np.flatnonzero(fresh)
    times, run, owner = np.diff(np.append(at, len(order))), run[at], group[text[at]]
    by = np.lexsort((owner, run))
    times, run, owner = times[by], run[by], owner[by]
    new = np.ones(len(by), bool)
    new[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    head = order[np.flatnonzero(first)][run[at]]
    return _strings(data, starts[head], lengths[head]), owner[at], np.diff(np.append(at, len(by))), np.add.reduceat(times, at)


def _long_text(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(term, occurrences) of one text, counted piece by piece."""
    found, at = [], 0
    while at < len(data):
        end = min(at + SLICE_BYTES, len(data))
        while end < len(data) and _LETTER[data[end]] and _LETTER[data[end - 1]]:
            end += 1
        terms, _, _, times = count_slice(data[at:end], np.array([0, end - at]), np.zeros(1, np.int64))
        found.append(pa.table({"term": terms, "count": times}))
        at = end
    whole = pa.concat_tables(found).group_by("term").aggregate([("count", "sum")])
    return whole["term"].combine_chunks(), whole["count_sum"].to_numpy()


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, sources = (pc.dictionary_encode(batch.column(name)) for name in ("lang", "source"))
        lang, source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (langs, sources))
        group = lang * len(sources.dictionary) + source
        texts = batch.column("text").cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, side="right")) - 1)
            data = _LOWER[raw[bounds[at] : bounds[end]]]
            if len(data) > SLICE_BYTES:
                terms, times = _long_text(data)
                owner, docs = np.full(len(times), group[at]), np.ones(len(times), np.int64)
            else:
                terms, owner, docs, times = count_slice(data, bounds[at : end + 1] - bounds[at], group[at:end])
            width = max(1, len(sources.dictionary))
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(owner // width)), sources.dictionary.take(pa.array(owner % width)), terms, pa.array(docs, pa.int64()), pa.array(times, pa.int64())],
                names=["lang", "source", "term", "docs", "count"],
            )
            at = end


def _named(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, count) of docs(text, lang, source): in how many rows a term occurs, and how often.

    A term is a maximal run of letters A-Z, a-z and characters beyond ASCII, A-Z lower-cased. Null text, lang and
    source are read as ''. Every row is a document, repeated rows too; texts may have any length.
    """
    ship_package(docs.sparkSession)
    found = _named(docs, "text", "lang", "source").mapInArrow(_count_batches, _COUNTED)
    return found.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"))


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, docs, uses) of the terms in at least ``least_docs`` documents of the language; uses has (source,
    count) for each source that uses the term."""
    terms = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "count")).alias("uses"))
    return terms.where(F.col("docs") >= least_docs)


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, terms) of every lang and source that occurs: occurrences of kept terms in
    the source and in the language, and how many terms the language keeps."""
    groups = _named(docs, "lang", "source").distinct()
    sums = kept.select("lang", F.inline("uses")).groupBy("lang", "source").agg(F.sum("count").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum(F.aggregate("uses", F.lit(0).cast("long"), lambda s, u: s + u["count"])).alias("lang_total"), F.count("*").alias("terms"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "terms")]
    return groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *zero)


def _share(count: str, total: str) -> Column:
    """1 + floor(SHARE * (count + 1) / (total + terms)), exact."""
    return F.expr(f"1 + cast({SHARE} as decimal(10, 0)) * cast({count} + 1 as decimal(20, 0)) div cast({total} + terms as decimal(20, 0))")


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SHARE * (count + 1) / whole), exact for up to 9 * 10**15: a long division by thousands."""
    part, rest = np.divmod(count + 1, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        part = part * 1000 + more
    return part + 1


def _divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def distinctive_terms(kept: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): for each source the terms of which it has a larger share than its language,
    by divergence, ties by the term's bytes, to rank ``top``."""
    whole = F.aggregate("uses", F.lit(0).cast("long"), lambda s, u: s + u["count"])
    used = kept.select("lang", "term", whole.alias("lang_count"), F.inline("uses"))
    side = F.broadcast(totals) if totals.count() <= BROADCAST_SOURCES else totals
    rows = used.join(side, ["lang", "source"]).withColumns({"p": _share("count", "total"), "q": _share("lang_count", "lang_total")})
    rows = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), _divergence("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _pair_sums(langs: dict) -> callable:
    """For mapInArrow: sums of divergences over the batches' terms, (lang, a, b, value) with a and b as numbers."""

    def rows(lang: str, i: int, j: int, sums: np.ndarray) -> pa.RecordBatch:
        a, b = (x.ravel() for x in np.indices(sums.shape))
        return pa.RecordBatch.from_arrays([pa.array([lang] * sums.size, pa.string()), pa.array(a + i * BLOCK_SOURCES, pa.int64()), pa.array(b + j * BLOCK_SOURCES, pa.int64()), pa.array(sums.ravel(), pa.int64())], names=["lang", "a", "b", "value"])

    def dense(owner: np.ndarray, place: np.ndarray, count: np.ndarray, terms: int, block: int, whole: np.ndarray) -> np.ndarray:
        """Shares of the block's sources in each term."""
        low, high = block * BLOCK_SOURCES, min((block + 1) * BLOCK_SOURCES, len(whole))
        counts = np.zeros((terms, high - low), np.int64)
        here = (place >= low) & (place < high)
        counts[owner[here], place[here] - low] = count[here]
        return shares(counts, whole[None, low:high])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for key in table.select(["lang", "i", "j"]).group_by(["lang", "i", "j"]).aggregate([]).to_pylist():
                lang, i, j = key["lang"], key["i"], key["j"]
                names, whole = langs.value[lang]
                mine = table.filter((pc.field("lang") == lang) & (pc.field("i") == i) & (pc.field("j") == j))
                step = max(1, CELLS // 4 // min(len(names), BLOCK_SOURCES))
                for at in range(0, len(mine), step):
                    uses = mine["uses"].slice(at, step).combine_chunks()
                    flat = uses.flatten()
                    place = pc.index_in(flat.field("source"), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
                    count = flat.field("count").to_numpy(zero_copy_only=False)
                    owner = pc.list_parent_indices(uses).to_numpy()
                    p, q = (dense(owner, place, count, len(uses), block, whole) for block in (i, j))
                    sums = held.setdefault((lang, i, j), np.zeros((p.shape[1], q.shape[1]), np.int64))
                    for b in range(q.shape[1]):
                        apart = p - q[:, b : b + 1]
                        sums[:, b] += (apart * apart // q[:, b : b + 1]).sum(axis=0)
                if sum(x.size for x in held.values()) > CELLS:
                    for spot, sums in held.items():
                        yield rows(*spot, sums)
                    held = {}
        for spot, sums in held.items():
            yield rows(*spot, sums)

    return run


def source_pairs(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every two sources of a language, with the sum of divergences over its terms.

    What goes through the driver is one row for each lang and source; the result has one for every two of them.
    Sums are taken in dense blocks of sources inside the tasks, so no pair of sources is a row before it is a sum.
    """
    spark = kept.sparkSession
    order = Window.partitionBy("lang").orderBy("source")
    placed = cut_lineage(totals.withColumn("place", (F.row_number().over(order) - 1).cast("long")))
    langs: dict[str, tuple[list, list]] = {}
    for row in placed.where("terms > 0").orderBy("lang", "place").toLocalIterator():
        names, whole = langs.setdefault(row.lang, ([], []))
        names.append(row.source)
        whole.append(row.total + row.terms)
    known = spark.sparkContext.broadcast({lang: (pa.array(names, pa.string()), np.array(whole, np.int64)) for lang, (names, whole) in langs.items()})
    spans = {lang: -(-len(names) // BLOCK_SOURCES) for lang, (names, _) in langs.items()}
    blocks = spark.createDataFrame([(lang, i, j) for lang, n in spans.items() for i in range(n) for j in range(n)], "lang string, i int, j int")
    rows = kept.select("lang", "uses").join(F.broadcast(blocks), "lang")
    sums = rows.mapInArrow(_pair_sums(known), "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = placed.select("lang", "source", F.col("place").alias("a"))
    two = placed.select("lang", F.col("source").alias("item"), F.col("place").alias("b"))
    pairs = one.join(two, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")).withColumn("rank", F.row_number().over(ranked))


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(text, lang, source); see the module's text.

    Each lang keeps the terms of at least ``least_docs`` of its rows. Null text, lang and source are read as '', and
    '' is a lang and a source like others; a source whose texts are empty is compared too (part pair), and where no
    term is kept its values are 0. Ranks count from 1 per lang, source and part, by falling value, ties by the
    item's UTF-8 bytes. Repeated rows are documents of their own, other columns are not read, and an empty table
    gives no rows. A word of any length is a term.
    """
    kept = cut_lineage(kept_terms(docs, least_docs).select("lang", "term", "uses"))
    totals = cut_lineage(group_totals(docs, kept))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = source_pairs(kept, totals).withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionByName(distinctive_terms(kept, totals, top).withColumn("part", F.lit("term")).select(*columns))
