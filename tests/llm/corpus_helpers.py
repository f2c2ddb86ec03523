"""Rows and brute-force versions that the tests of the operators and of the pipeline share."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np

from foldwright.llm import minhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tokens(text):
    return re.findall(r"[^\W_]+", text.lower())


def grams(text, size=5):
    w = tokens(text)
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def prose(seed, words, vocabulary=5000):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" + ("." if rnd.random() < 0.1 else "") for _ in range(words))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows], DOCS)


def edge_rows():
    """Null and empty texts, nulls in every column, repeated rows, ties and a very long text."""
    long = prose(1, 120_000)
    return [
        (None, None, None, None), (1, None, "en", "a"), (2, "", "en", "a"), (3, "!!! ...", None, "a"), (None, "one two", "en", None),
        (4, prose(4, 60), "en", "a"), (4, prose(4, 60), "en", "a"), (5, prose(4, 60), "de", None), (6, long, "en", "b"), (7, long, "en", "b"), (8, "x", "fr", "b"),
    ]


def weighted(text):
    pairs = sorted((hash(g) & ((1 << 60) - 1), n) for g, n in grams(text).items())
    return np.array([p for p, _ in pairs], np.uint64), np.array([n for _, n in pairs], float)


def classes_by_brute_force(rows):
    parent = {i: i for i, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: weighted(t) for i, t, *_ in rows}
    for (i, *_), (j, *_) in itertools.combinations(rows, 2):
        if minhash.probability_jaccard(sets[i], sets[j]) >= 0.8:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {i: find(i) for i in parent}


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}
