"""Substring dedup by sliding sentence spans.

A text is cut into sentences at line ends and after full stops, question and exclamation marks before white space.
From every sentence a span starts, and at every sentence one ends: the shortest run of ``run`` or more sentences with
``min_words`` words. Those inside a longer run cover it from its first to its last sentence. Single
sentences of ``long_sentence`` words are spans too, as a repeated passage may hold no more than one whole sentence.
Spans are hashed by their words in any case and joined globally; of each repeated span the first occurrence, by
doc_id, text and place, stays, and every sentence that another occurrence covers is removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from foldwright.llm import words as W
from foldwright.llm.rows import text_hash
from foldwright.session import cut_lineage, ship_package

RUN = 2
MIN_WORDS = 10
LONG_SENTENCE = 20
_BREAK = regex.compile(r"[.!?](?=\s)|\n")


@cache
def _lower_case() -> np.ndarray:
    """The lower-case form of each code point, where it is one code point."""
    return np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x110000)], np.uint32)


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """Parts of a text of about PIECE_CHARS characters that end where a sentence does."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > W.PIECE_CHARS:
            found = _BREAK.search(text, at + W.PIECE_CHARS)
            end = found.end() if found else end
        yield at, text[at:end]
        at = end


def sentences(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, words) of the sentences that have words. A sentence ends where the next one starts; the first
    starts at 0."""
    starts, hashes, counts = [], [], []
    for at, piece in _pieces(text):
        codes = W.code_points(piece)
        words, values = W._hash_words(_lower_case()[codes])
        if not len(words):
            continue
        space = np.ones(len(codes) + 1, bool)
        space[:-1] = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0x85) | (codes == 0xA0)
        stop = ((codes == 46) | (codes == 33) | (codes == 63)) & space[1:] | (codes == 10)
        part = np.cumsum(stop)[words]
        breaks = np.concatenate([[0], np.flatnonzero(stop) + 1])
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        size = np.diff(np.append(first, len(words)))
        place = np.arange(len(words)) - np.repeat(first, size)
        starts.append(breaks[part[first]] + at)
        hashes.append(W.mix(np.add.reduceat(W.mix(values ^ W.mix(place.astype(np.uint64))), first)))
        counts.append(size)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start = np.concatenate(starts)
    start[0] = 0
    return start, np.concatenate(hashes), np.concatenate(counts)


def spans(hashes: np.ndarray, counts: np.ndarray, run: int, min_words: int, long_sentence: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first sentence, sentences) of a text's spans, each once."""
    n = len(hashes)
    if n == 0:
        return hashes, np.zeros(0, np.int32), np.zeros(0, np.int32)
    total = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(n)
    end = np.maximum(np.searchsorted(total, total[:-1] + min_words), at + run)
    fits = end <= n
    back = np.minimum(np.searchsorted(total, total[1:] - min_words, side="right") - 1, at + 1 - run)
    ends = back >= 0
    both = np.unique(np.concatenate([at[fits] * (n + 1) + end[fits], back[ends] * (n + 1) + at[ends] + 1]))
    begin, end = np.divmod(both, n + 1)
    # hash of a run: differences of a running sum of hash * base ** place, moved back to place 0
    power, inverse = W._powers(1 << max(12, int(n).bit_length()))
    summed = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power[:n], out=summed[1:])
    value = W.mix((summed[end] - summed[begin]) * inverse[begin] ^ (end - begin).astype(np.uint64))
    alone = np.flatnonzero(counts >= long_sentence)
    return (
        np.concatenate([value, W.mix(hashes[alone] + np.uint64(1))]),
        np.concatenate([begin, alone]).astype(np.int32),
        np.concatenate([end - begin, np.ones(len(alone), np.int64)]).astype(np.int32),
    )


def _span_batches(run: int, min_words: int, long_sentence: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found, rows, size = [], [], 0
            for i, text in enumerate(texts):
                if text:
                    _, hashes, counts = sentences(text)
                    found.append(spans(hashes, counts, run, min_words, long_sentence))
                    rows.append(np.full(len(found[-1][0]), i))
                    size += len(rows[-1])
                if found and (size >= 100_000 or i == len(texts) - 1):
                    at = pa.array(np.concatenate(rows))
                    value, begin, count = (np.concatenate([x[k] for x in found]) for k in range(3))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(value.view(np.int64)), pa.array(begin.astype(np.int64) << 32 | count)],
                        names=["doc_id", "th", "span", "at"],
                    )
                    found, rows, size = [], [], 0

    return work


def repeated_sentences(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, long_sentence: int = LONG_SENTENCE) -> DataFrame:
    """(doc_id, th, removed): for each text with sentences to remove their sorted numbers, from 0.

    One row for each doc_id and text: repeated rows are one document, which does not repeat itself, while copies under
    other doc_ids are removed whole but for the smallest, if the text is long enough for a run. A null doc_id comes after all others. Null and empty texts,
    and texts without words, have no sentences.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), "text").where("text is not null")
    every = rows.mapInArrow(_span_batches(run, min_words, long_sentence), "doc_id long, th long, span long, at long")
    every = cut_lineage(every)  # at: the first sentence above, the number of sentences below 32 bits
    many = every.groupBy("span").agg(F.count("*").alias("times")).where("times > 1").select("span")
    again = cut_lineage(every.join(many, "span", "left_semi"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "at")
    first = again.groupBy("span").agg(F.min(place).alias("first"))
    later = again.join(first, "span").where(~place.eqNullSafe(F.col("first")))
    # a text's spans meet before their sentences are listed, which moves fewer rows
    held = later.groupBy("doc_id", "th").agg(F.collect_list("at").alias("spots"))
    listed = "flatten(transform(spots, at -> sequence(cast(at >> 32 as int), cast((at >> 32) + (at & 4294967295L) - 1 as int))))"
    return held.select("doc_id", "th", F.expr(f"array_sort(array_distinct({listed}))").alias("removed"))


def _clean_batches(names: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = batch.column("text").to_pylist(), batch.column("__removed").to_pylist()
            sizes = []
            for i, (text, gone) in enumerate(zip(texts, removed, strict=True)):
                start = sentences(text)[0] if text else np.zeros(0, np.int64)
                sizes.append(len(start))
                if gone:
                    bounds = np.append(start, len(text))
                    keep = np.ones(len(start), bool)
                    keep[gone] = False
                    texts[i] = "".join(text[bounds[k] : bounds[k + 1]] for k in np.flatnonzero(keep))
            columns = {n: batch.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([*columns.values(), batch.column("__removed"), pa.array(sizes, pa.int32())], names=[*columns, "removed", "sentences"])

    return work


def drop_repeated_spans(docs: DataFrame, **options) -> DataFrame:
    """docs with their texts without repeated sentences, and the columns removed (sentence numbers, null if none)
    and sentences (how many there were; existing columns of these names are replaced). A text may become empty; null
    texts stay null; rows are never dropped."""
    docs = docs.drop("removed", "sentences")
    gone = repeated_sentences(docs, **options).select(F.col("doc_id").alias("__doc_id"), F.col("th").alias("__th"), F.col("removed").alias("__removed"))
    marked = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__text": text_hash()})
    joined = marked.join(gone, marked["__doc"].eqNullSafe(F.col("__doc_id")) & marked["__text"].eqNullSafe(F.col("__th")), "left")
    schema = StructType([docs.schema[c] for c in docs.columns]).add("removed", ArrayType(IntegerType())).add("sentences", "integer")
    return joined.select(*docs.columns, "__removed").mapInArrow(_clean_batches(docs.columns), schema)
