"""The divergence audit against brute force, pointer sort against sorted(), and its edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus_helpers import DOCS, edge_rows, prose, table
from pyspark.sql import functions as F

from foldwright.llm import divergence

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def audit_by_brute_force(rows, least=3, top=200):
    uses, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = Counter(WORD.findall((text or "").translate(LOWER)))
        uses[lang, source].update(found)
        docs[lang].update(found.keys())
    kept = {lang: sorted(t for t, n in docs[lang].items() if n >= least) for lang in {lang for lang, _ in groups}}
    out = set()

    def shares(counts, terms):
        total = sum(counts[t] for t in terms) + len(terms)
        return {t: 1 + 10**9 * (counts[t] + 1) // total for t in terms}

    def ranked(lang, source, part, values, most):
        order = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))
        out.update((lang, source, part, item, value, i) for i, (item, value) in enumerate(order, 1) if most is None or i <= most)

    for lang, source in groups:
        terms = kept[lang]
        p = shares(uses[lang, source], terms)
        whole = sum((uses[g] for g in groups if g[0] == lang), Counter())
        q = shares(whole, terms)
        others = {s: shares(uses[lang, s], terms) for x, s in groups if x == lang and s != source}
        ranked(lang, source, "pair", {s: sum((p[t] - o[t]) ** 2 // o[t] for t in terms) for s, o in others.items()}, None)
        ranked(lang, source, "term", {t: (p[t] - q[t]) ** 2 // q[t] for t in terms if uses[lang, source][t] and p[t] > q[t]}, top)
    return out


def got(docs, **options):
    return [tuple(r) for r in divergence.audit_sources(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect()]


def mixed_rows(seed, many):
    rnd = random.Random(seed)
    words = ["the", "The", "élan", "ÉLAN", "international", "internationally", "internationalise", "a", "Z", "日本", "x" * 40, "x" * 41, "naïve"]
    parts = [" ", "\n", ". ", "9", "_", "–", "`", "@"]
    pick = lambda: "".join(rnd.choice(words) + rnd.choice(parts) for _ in range(rnd.randrange(0, 30)))
    return [(i, pick() if rnd.random() > 0.05 else None, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "ä", None, "a"])) for i in range(many)]


def test_audit_equals_brute_force(spark):
    rows = mixed_rows(1, 120)
    out = got(table(spark, rows))
    assert len(out) == len(set(out)) and set(out) == audit_by_brute_force(rows)


def test_small_slices_blocks_and_ranks_change_nothing(spark, monkeypatch):
    rows = mixed_rows(2, 60)
    rows += [(900 + i, prose(i, 30, 12), "en", f"s{i:02d}") for i in range(9)]
    for name, value in (("BLOCK_SOURCES", 2), ("CELLS", 8)):
        monkeypatch.setattr(divergence, name, value)
    assert set(got(table(spark, rows), least_docs=2, top=5)) == audit_by_brute_force(rows, least=2, top=5)


def test_pointer_sort_equals_sorted():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abAB é日.") for _ in range(rnd.randrange(60))) for _ in range(200)] + ["", "same" * 9, "same" * 9]
    raw = [t.encode() for t in texts]
    data = divergence._LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    offsets = np.cumsum([0, *map(len, raw)])
    starts, lengths, owner = divergence.word_pointers(data, offsets)
    order, first = divergence.pointer_sort(data, starts, lengths)
    words = [data[s : s + n].tobytes() for s, n in zip(starts, lengths, strict=True)]
    want = [(w.translate(LOWER).encode(), i) for i, t in enumerate(texts) for w in WORD.findall(t)]
    assert sorted(zip(words, owner.tolist(), strict=True)) == sorted(want)
    ordered = [words[i] for i in order]
    assert ordered == sorted(words) and list(first) == [i == 0 or w != ordered[i - 1] for i, w in enumerate(ordered)]


def test_long_text_in_pieces(monkeypatch):
    text = (prose(7, 4000, 50) + " " + "y" * 3000 + " É" * 50).encode()
    data = divergence._LOWER[np.frombuffer(text, np.uint8)]
    monkeypatch.setattr(divergence, "SLICE_BYTES", 101)
    terms, times = divergence._long_text(data)
    assert Counter(dict(zip(terms.to_pylist(), times.tolist(), strict=True))) == Counter(WORD.findall(text.decode().translate(LOWER)))


def test_shares_are_exact():
    rnd = random.Random(5)
    whole = [rnd.randrange(1, 9 * 10**15) for _ in range(200)] + [1, 10**9, 9 * 10**15]
    count = [rnd.randrange(0, w) for w in whole]
    assert divergence.shares(np.array(count), np.array(whole)).tolist() == [1 + 10**9 * (c + 1) // w for c, w in zip(count, whole, strict=True)]


@pytest.mark.parametrize("partitions", [1, 5])
def test_edges(spark, partitions):
    rows = edge_rows()
    docs = table(spark, rows).withColumns({"term": F.lit("mine"), "count": F.lit(1), "rank": F.lit("r"), "place": F.lit(2), "uses": F.lit(0)})
    assert set(got(docs.repartition(partitions))) == audit_by_brute_force(rows)


def test_empty_table_and_no_kept_terms(spark):
    assert got(spark.createDataFrame([], DOCS)) == []
    rows = [(1, "one", "en", "a"), (2, "two", "en", "b"), (3, "", "en", "c")]
    out = got(table(spark, rows))
    assert set(out) == audit_by_brute_force(rows) and {r[4] for r in out} == {0} and len(out) == 6
