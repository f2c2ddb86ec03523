"""Quality scores by positive-unlabelled learning with a non-negative risk.

Trusted positives are documents labelled 1; all other texts of the training rows are unlabelled web text, whatever
their label. The class prior is estimated from the two samples' score distributions: the smallest ratio of the
unlabelled to the positive share above a threshold. A small network on text features is then fitted to the unbiased
risk, whose negative part is held at zero or more: where it would turn negative, the step goes the other way.

The rows that a network is fitted on are bounded samples (``SAMPLE_ROWS``, the rows of smallest seeded hash of id and
text). The class prior is a statistic of the corpus: a plain network, fitted on one half of the rows, scores all rows
of the other half in Spark, and the prior comes from the counts of their scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foldwright.llm import words as W
from foldwright.llm.rows import key_filter, with_maybe
from foldwright.session import ship_package

#: Most positives, and most unlabelled texts, that a model is fitted on.
SAMPLE_ROWS = 20_000
GRAMS = 64
FEATURES = 18 + 2 * GRAMS
HIDDEN = 32
EPOCHS = 60
BATCH = 1000
#: Share of a sample above a threshold that counts in the prior's estimate at least.
LEAST_SHARE = 0.05
#: Scores are counted in so many bins of the margin, which is cut at +-MARGIN.
SCORE_BINS, MARGIN = 4000, 20.0

_KINDS: list[np.ndarray] = []


def _kind(codes: np.ndarray) -> np.ndarray:
    """0 other mark, 1 lower letter, 2 upper letter, 3 digit, 4 space, 5 sentence end, 6 comma-like, 7 other letter."""
    if not _KINDS:
        table = np.zeros(0x110000, np.int8)
        for c in range(0x110000):
            ch = chr(c)
            if ch.islower():
                table[c] = 1
            elif ch.isupper():
                table[c] = 2
            elif ch.isdigit():
                table[c] = 3
            elif ch.isspace():
                table[c] = 4
            elif ch.isalpha():
                table[c] = 7
        table[[ord(c) for c in ".!?"]] = 5
        table[[ord(c) for c in ",;:'-"]] = 6
        _KINDS.append(table)
    return _KINDS[0][codes]


def text_features(text: str | None) -> np.ndarray:
    """Shares and shapes of one whole text; zeros for a null or empty one.

    Shares of character kinds; length; word lengths; distinct share of words, of word pairs and of lines; repeats of
    the word before; share of the most frequent word; sentence length; and hashed pairs of character kinds and of
    lower-cased characters, which tell common from odd sequences.
    """
    out = np.zeros(FEATURES)
    if not text:
        return out
    doc_words = [h for _, _, _, h in W.word_hashes([text])][0]
    codes = W.code_points(text)
    kinds = _kind(codes)
    n = len(codes)
    share = np.bincount(kinds, minlength=8) / n
    out[:8] = share
    out[8] = np.log1p(n) / 10
    words = len(doc_words)
    gaps = np.flatnonzero(np.diff(np.concatenate([[1], (kinds == 4).astype(np.int8), [1]])))
    lengths = gaps[1::2] - gaps[::2]
    if len(lengths):
        out[9], out[10] = lengths.mean() / 10, lengths.std() / 10
    if words:
        _, times = np.unique(doc_words, return_counts=True)
        out[11] = len(times) / words
        out[12] = times.max() / words
        out[13] = np.log1p(words) / 10
    if words > 1:
        out[14] = (doc_words[1:] == doc_words[:-1]).mean()
        out[15] = len(np.unique(doc_words[1:] * np.uint64(3) + doc_words[:-1])) / (words - 1)
    lines = [x for x in text.split("\n") if x.strip()]
    if lines:
        out[16] = len(set(lines)) / len(lines)
    out[17] = words / (1 + int((kinds == 5).sum())) / 50
    if n > 1:
        out[18 : 18 + GRAMS] = np.bincount(kinds[1:].astype(np.int64) * 8 + kinds[:-1], minlength=GRAMS) / (n - 1)
        low = W.code_points(text.lower()).astype(np.uint64)
        place = W.mix(low[1:] * np.uint64(0x100003) + low[:-1]) & np.uint64(GRAMS - 1)
        out[18 + GRAMS :] = np.bincount(place.astype(np.int64), minlength=GRAMS) / max(1, len(low) - 1)
    return out


@dataclass
class QualityModel:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def margin(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.scale, -8, 8)
        return np.maximum(x @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(features), -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = LEAST_SHARE) -> float:
    """Upper bound of the share of positives among the unlabelled: the smallest ratio of the two shares in any upper
    or lower tail of a score that holds at least ``least`` of the positives, widened by a standard error.

    positive and unlabelled count the rows in each bin of the score, in the bins' order.
    """
    best, n_p, n_u = 1.0, positive.sum(), unlabelled.sum()
    for flip in (1, -1):
        p, u = np.cumsum(positive[::flip]) / n_p, np.cumsum(unlabelled[::flip]) / n_u
        error = np.sqrt(u * (1 - u) / n_u) + np.sqrt(p * (1 - p) / n_p)
        fit = (p >= least) & (p <= 1 - least)
        if fit.any():
            best = min(best, float(((u + error)[fit] / p[fit]).min()))
    return float(np.clip(best, 0.05, 0.99))


def margin_bins(margins: np.ndarray) -> np.ndarray:
    return np.clip((margins + MARGIN) / (2 * MARGIN) * SCORE_BINS, 0, SCORE_BINS - 1).astype(np.int64)


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 7) -> QualityModel:
    """Adam on mini-batches. With a prior the non-negative risk, without one plain positive against unlabelled."""
    everything = np.concatenate([positive, unlabelled])
    mean, scale = everything.mean(axis=0), everything.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(seed)
    dims = positive.shape[1]
    params = [rng.normal(0, np.sqrt(2 / dims), (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    p_all, u_all = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    step = 0
    batches = max(1, -(-max(len(p_all), len(u_all)) // BATCH))
    for epoch in range(EPOCHS):
        rate = 3e-3 * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS)) + 1e-5
        parts_p, parts_u = (np.array_split(rng.permutation(len(x)), batches) for x in (p_all, u_all))
        for at_p, at_u in zip(parts_p, parts_u, strict=True):
            if len(at_p) == 0 or len(at_u) == 0:
                at_p, at_u = (a if len(a) else rng.integers(0, m, 1) for a, m in ((at_p, len(p_all)), (at_u, len(u_all))))
            x = np.concatenate([p_all[at_p], u_all[at_u]])
            n_p = len(at_p)
            act = np.maximum(x @ params[0] + params[1], 0)
            belief = 1 / (1 + np.exp(-np.clip(act @ params[2] + params[3], -30, 30)))
            slope = np.zeros(len(x))
            if prior is None:
                slope[:n_p], slope[n_p:] = 0.5 * (belief[:n_p] - 1) / n_p, 0.5 * belief[n_p:] / len(at_u)
            else:
                # logistic loss: of a positive -log(belief), of a negative -log(1 - belief)
                as_negative = -np.log(np.maximum(1 - belief, 1e-12))
                negative_risk = as_negative[n_p:].mean() - prior * as_negative[:n_p].mean()
                down_p, down_u = -prior * belief[:n_p] / n_p, belief[n_p:] / len(at_u)
                if negative_risk >= 0:
                    slope[:n_p], slope[n_p:] = prior * (belief[:n_p] - 1) / n_p + down_p, down_u
                else:
                    slope[:n_p], slope[n_p:] = -down_p, -down_u
            back = slope[:, None] * params[2][None, :] * (act > 0)
            grads = [x.T @ back + 1e-4 * params[0], back.sum(axis=0), act.T @ slope + 1e-4 * params[2], np.array([slope.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(prior if prior is not None else 0.5, mean, scale, params[0], params[1], params[2], float(params[3][0]))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [text_features(t) for t in batch.column("text").to_pylist()]
        flat = np.concatenate(values) if values else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), FEATURES).cast(pa.list_(pa.float64()))], names=["features"])


def _draw() -> Column:
    """A row's seeded hash; equal rows share it, rows of one id or of null ids do not."""
    return F.xxhash64("doc_id", "text", F.lit("quality"))


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """Features of at most about ``most`` texts: those whose hash is below the share that the count asks for."""
    count = rows.count()
    if count > most:
        rows = rows.where(F.pmod(F.shiftrightunsigned("__draw", 1), F.lit(1 << 40)) < int(most / count * (1 << 40)))
    rows = rows.dropDuplicates(["__draw"])  # however often one text repeats, it comes once
    found = rows.select("text").mapInArrow(_feature_batches, "features array<double>").toArrow()
    return found.column("features").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)


def _score_counts(rows: DataFrame, good: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """How many of the rows that good(doc_id) names, and of the others, have their margin in each bin.

    Texts are scored where they are read; only ids and bins are joined and added up.
    """
    known = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            margins = known.value.margin(np.stack([text_features(t) for t in texts])) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(margin_bins(margins).astype(np.int32))], names=["doc_id", "bin"])

    schema = StructType([rows.schema["doc_id"]]).add("bin", "integer")
    each = rows.select("doc_id", "text").mapInArrow(run, schema).groupBy("doc_id", "bin").agg(F.count("*").alias("rows"))
    marked = each.join(good.withColumn("good", F.lit(1)), "doc_id", "left").groupBy(F.col("good").isNotNull().alias("good"), "bin")
    out = np.zeros((2, SCORE_BINS), np.int64)
    for r in marked.agg(F.sum("rows").alias("rows")).collect():
        out[int(r["good"]), r["bin"]] = r["rows"]
    return out[1], out[0]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """A model of docs(doc_id, text) and labels(doc_id, quality).

    Positives are the documents with a label of quality 1 (several labels: any of them); all other documents are
    unlabelled. Null and empty texts teach nothing, and repeated rows teach once. Without positives or without
    unlabelled texts every text scores 0.5; with too few to measure the prior on, it is 0.5.
    """
    ship_package(docs.sparkSession)
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    rows = docs.where("text is not null and text <> ''").select("doc_id", "text").withColumn("__draw", _draw())
    # a bounded filter keeps almost all other texts from being shuffled to find the positives
    key = F.xxhash64("doc_id")
    likely = with_maybe(rows, key, key_filter(good.select(key.alias("key")))).where("__maybe").drop("__maybe")
    positive, unlabelled = likely.join(good, "doc_id", "left_semi"), rows.join(good, "doc_id", "left_anti")
    p_all, u_all = _sample(positive, sample_rows), _sample(unlabelled, sample_rows)
    if len(p_all) < 2 or len(u_all) < 2:
        zeros = np.zeros(FEATURES)
        return QualityModel(0.5, zeros, zeros + 1, np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    # the prior's score must not have seen the rows it is measured on
    fitted, measured = "(__draw & 1) = 0", "(__draw & 1) = 1"
    p_half, u_half = _sample(positive.where(fitted), sample_rows), _sample(unlabelled.where(fitted), sample_rows)
    prior = 0.5
    if len(p_half) and len(u_half):
        plain = _fit(p_half, u_half, None)
        p_counts, u_counts = _score_counts(rows.where(measured), good, plain)
        if p_counts.any() and u_counts.any():
            prior = estimate_prior(p_counts, u_counts)
    return _fit(p_all, u_all, prior)


def _score_batches(known, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            score = known.value.score(np.stack([text_features(t) for t in texts])) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*keys, "score", "predicted"])

    return run


def score(docs: DataFrame, model: QualityModel, keys: list[str]) -> DataFrame:
    """keys with score (0 to 1) and predicted (1 if score >= 0.5), one row per row of docs(text, keys...).

    Only the text is read. A null text scores like an empty one, whose features are all zero. Repeated rows are
    scored each; keys named like a result are replaced by it; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    keys = [k for k in keys if k not in ("score", "predicted")]
    schema = StructType([docs.schema[k] for k in keys]).add("score", "double").add("predicted", "integer")
    return docs.select(*dict.fromkeys([*keys, "text"])).mapInArrow(_score_batches(docs.sparkSession.sparkContext.broadcast(model), keys), schema)
