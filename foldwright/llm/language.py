"""Language identification with error-correcting output codes over character n-grams.

Every language gets a codeword of +1 and -1; for each bit a binary classifier tells the languages with +1 from those
with -1. A classifier is a log-odds model of hashed character n-grams (1 to 3) whose probabilities come from all
training texts, with a threshold and a scale from the training texts' margins. A text's decoded language is the one
whose codeword has the smallest total loss; each bit's loss counts by how reliable that bit was in training. If the
runner-up is nearly as close, the text is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foldwright.llm import words as W
from foldwright.session import ship_package

BUCKETS = 8192
#: Added to each n-gram share before its logarithm.
FLOOR = 1e-6
UNKNOWN = "und"
#: A text is ambiguous if its decoded share of belief is below this.
AMBIGUOUS_BELOW = 0.6
PIECE_CHARS = 250_000
_GRAM = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0x2545F4914F6CDD1D)]


def code_matrix(languages: int, seed: int = 17) -> np.ndarray:
    """Codewords (languages, bits) of +1 and -1, no two columns equal or opposite.

    Up to seven languages have all 2 ** (languages - 1) - 1 splits; more have about 10 * log2(languages) random
    columns, the draw of the largest smallest distance out of 200.
    """
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= 7:
        columns = [np.where(np.isin(np.arange(languages), [0, *rest]), 1.0, -1.0) for k in range(languages - 1) for rest in combinations(range(1, languages), k)]
        return np.stack(columns, axis=1)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (languages, int(np.ceil(10 * np.log2(languages)))))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        gap = min((code[a] != code[b]).sum() for a, b in combinations(range(languages), 2))
        if gap > far:
            best, far = code, gap
    return best


def gram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams of the lower-cased letters, runs of other characters being one space; None
    without letters."""
    total, letters = np.zeros(buckets), 0
    for at in range(0, len(text), PIECE_CHARS):
        piece = text[at : at + PIECE_CHARS].lower()
        codes = W.code_points(piece)
        inside = _letters()[codes]
        letters += int(inside.sum())
        codes = np.where(inside, codes, 32).astype(np.uint64)
        keep = np.ones(len(codes), bool)
        keep[1:] = inside[1:] | inside[:-1]
        codes = np.concatenate([[np.uint64(32)], codes[keep], [np.uint64(32)]])
        key = np.zeros(len(codes), np.uint64)
        for n in range(3):
            key = key[: len(codes) - n] * _GRAM[0] + codes[n:] * _GRAM[1]
            place = ((key ^ (key >> np.uint64(29))) * _GRAM[2]) >> np.uint64(64 - int(np.log2(buckets)))
            total += np.bincount(place.astype(np.int64), minlength=buckets)
    return total if letters else None


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        import sys

        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def _mean_grams(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the texts with letters, and their n-gram shares."""
    found = [(i, c) for i, t in enumerate(texts) if t is not None and (c := gram_counts(t, buckets)) is not None]
    at = np.array([i for i, _ in found], np.int64)
    shares = np.stack([c / c.sum() for _, c in found]) if found else np.zeros((0, buckets))
    return at, shares


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # (languages, bits)
    weights: np.ndarray  # (buckets, bits)
    middle: np.ndarray  # (bits)
    scale: np.ndarray  # (bits)
    trust: np.ndarray  # (bits)

    def decode(self, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language index, belief in it) of n-gram shares (texts, buckets)."""
        if self.code.shape[1] == 0:
            return np.zeros(len(shares), np.int64), np.ones(len(shares))
        margin = (shares @ self.weights - self.middle) / self.scale
        loss = np.logaddexp(0.0, -margin[:, None, :] * self.code[None]) @ self.trust
        belief = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        belief /= belief.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        return best, belief[np.arange(len(best)), best]


def _slices(texts: list, size: int = 256) -> Iterator[tuple[int, list]]:
    for at in range(0, len(texts), size):
        yield at, texts[at : at + size]


def _sums(buckets: int):
    """One row (lang, texts, sum of shares) for each language of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[int, np.ndarray]] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
            for start, part in _slices(texts):
                at, shares = _mean_grams(part, buckets)
                own = langs[start + at]
                for lang in dict.fromkeys(own):
                    count, before = total.get(lang, (0, np.zeros(buckets)))
                    total[lang] = (count + int((own == lang).sum()), before + shares[own == lang].sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([list(s) for _, s in total.values()], pa.list_(pa.float64()))],
            names=["lang", "texts", "shares"],
        )

    return run


def _margins(languages: list[str], weights: np.ndarray, buckets: int):
    """For each language and bit: number, sum and sum of squares of the margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: i for i, lang in enumerate(languages)}
        bits = weights.shape[1]
        total = np.zeros((len(languages), 3, bits))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = np.array([place.get(x, -1) for x in batch.column("lang").to_pylist()])
            for start, part in _slices(texts):
                at, shares = _mean_grams(part, buckets)
                margin, lang = shares @ weights, own[start + at]
                for k in np.unique(lang[lang >= 0]):
                    m = margin[lang == k]
                    total[k] += np.stack([np.full(bits, len(m)), m.sum(axis=0), (m * m).sum(axis=0)])
        rows = np.argwhere(np.ones((len(languages), bits), bool))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[:, 0]), pa.array(rows[:, 1]), *[pa.array(total[rows[:, 0], k, rows[:, 1]]) for k in range(3)]], names=["lang", "bit", "n", "sum", "squares"]
        )

    return run


def train(docs: DataFrame, buckets: int = BUCKETS) -> LanguageModel:
    """A model of docs(text, lang). Rows without a language or without a letter teach nothing.

    What reaches the driver is one vector for each language and for each language and bit.
    """
    spark = ship_package(docs.sparkSession)
    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    partial = rows.mapInArrow(_sums(buckets), "lang string, texts long, shares array<double>")
    cells = partial.select("lang", "texts", F.posexplode("shares").alias("spot", "share"))
    merged = cells.groupBy("lang", "spot").agg(F.sum("share").alias("share"), F.sum("texts").alias("texts"))
    sums: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for row in merged.groupBy("lang").agg(F.max("texts").alias("texts"), F.array_sort(F.collect_list(F.struct("spot", "share"))).alias("cells")).toLocalIterator():
        vector = np.zeros(buckets)
        vector[[c.spot for c in row.cells]] = [c.share for c in row.cells]
        sums[row.lang], texts[row.lang] = vector, row.texts
    languages = sorted(sums)
    code = code_matrix(len(languages))
    bits = code.shape[1]
    if bits == 0:
        empty = np.zeros(0)
        return LanguageModel(languages, code, np.zeros((buckets, 0)), empty, empty, empty)
    mean = np.stack([sums[x] / texts[x] for x in languages])  # each language counts alike, however frequent
    weights = np.zeros((buckets, bits))
    for b in range(bits):
        sides = [mean[code[:, b] == s].mean(axis=0) for s in (1.0, -1.0)]
        weights[:, b] = np.log(sides[0] + FLOOR) - np.log(sides[1] + FLOOR)
    stats = rows.mapInArrow(_margins(languages, weights, buckets), "lang long, bit long, n double, sum double, squares double")
    got = np.zeros((len(languages), bits, 3))
    for r in stats.groupBy("lang", "bit").agg(F.sum("n").alias("n"), F.sum("sum").alias("s"), F.sum("squares").alias("q")).collect():
        got[r.lang, r.bit] = r.n, r.s, r.q
    mu = got[:, :, 1] / np.maximum(got[:, :, 0], 1)
    var = np.maximum(got[:, :, 2] / np.maximum(got[:, :, 0], 1) - mu**2, 1e-12)
    middle, scale, trust = np.zeros(bits), np.ones(bits), np.ones(bits)
    for b in range(bits):
        # the two languages nearest to the boundary set it, in proportion to their spreads
        plus, minus = np.flatnonzero(code[:, b] > 0), np.flatnonzero(code[:, b] < 0)
        hi = plus[np.argmin(mu[plus, b])]
        lo = minus[np.argmax(mu[minus, b])]
        sd_hi, sd_lo = np.sqrt(var[hi, b]), np.sqrt(var[lo, b])
        middle[b] = (mu[hi, b] * sd_lo + mu[lo, b] * sd_hi) / (sd_hi + sd_lo)
        gap = max(mu[hi, b] - mu[lo, b], 1e-9)
        scale[b] = gap / 8
        trust[b] = min(max(gap / (sd_hi + sd_lo), 0.05), 8.0)
    trust /= trust.sum() / bits
    return LanguageModel(languages, code, weights, middle, scale, trust)


def _predictions(model: LanguageModel, buckets: int, limit: float, text: str, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            ambiguous = np.zeros(len(texts), bool)
            for start, part in _slices(texts):
                at, shares = _mean_grams(part, buckets)
                if len(at) and model.languages:
                    best, belief = model.decode(shares)
                    pred[start + at] = np.array(model.languages, object)[best]
                    score[start + at] = belief
                    ambiguous[start + at] = belief < limit
            kept = [(n, batch.column(n)) for n in keys]
            found = [("lang_pred", pa.array(pred, pa.string())), ("score", pa.array(score)), ("ambiguous", pa.array(ambiguous))]
            yield pa.RecordBatch.from_arrays([c for _, c in kept + found], names=[n for n, _ in kept + found])

    return run


def identify(docs: DataFrame, model: LanguageModel, keys: list[str], buckets: int = BUCKETS, ambiguous_below: float = AMBIGUOUS_BELOW, text: str = "text") -> DataFrame:
    """keys plus lang_pred, score (0 to 1) and ambiguous, one row per row of docs(text, keys...).

    Only the text is read for a prediction. A null text or one without letters is ``und`` with score 0 and not
    ambiguous; with an empty model every text is. Repeated rows are predicted each; keys named like a result are
    replaced by it. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    keys = [k for k in keys if k not in ("lang_pred", "score", "ambiguous")]
    schema = StructType([docs.schema[k] for k in keys]).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return docs.select(*dict.fromkeys([*keys, text])).mapInArrow(_predictions(model, buckets, ambiguous_below, text, keys), schema)


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs whose language is known: not ``und`` and not ambiguous. Columns of any name pass unchanged."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = identify(docs.toDF(*names), model, names, text=names[docs.columns.index("text")])
    return found.where(f"lang_pred <> '{UNKNOWN}' and not ambiguous").select(*names).toDF(*docs.columns)


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the key as text leaves ``part`` modulo ``parts``; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))
