"""The dealt operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus_helpers import DOCS, classes_by_brute_force, edge_rows, grams, plain_targets, prose, table, tokens
from pyspark.sql import functions as F

from foldwright.llm import decontaminate, language, lines, minhash, mixing, quality, sharding, spans, topk, warc
from foldwright.llm import words as W
from foldwright.llm.groups import connected_components, link_groups, shared_keys
from foldwright.session import scratch_path

@pytest.fixture(scope="module")
def edges(spark):
    return table(spark, edge_rows()).withColumns({"size": F.lit("mine"), "removed": F.lit(1), "score": F.lit("s"), "node": F.lit(0), "key": F.lit(0)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_of_pieces_equal_words_of_the_whole(monkeypatch):
    text = prose(3, 3000) + " Äß–日本 " + prose(5, 10)
    whole = [h for _, _, _, h in W.word_hashes([text])][0]
    monkeypatch.setattr(W, "PIECE_CHARS", 97)
    pieces = [h for _, _, _, h in W.word_hashes([text])][0]
    assert (whole == pieces).all() and len(whole) == len(tokens(text))
    assert len(set(whole.tolist())) == len(set(tokens(text)))


def test_shingles_count_like_plain_python():
    texts = [prose(i, n) for i, n in enumerate((0, 1, 3, 4, 5, 6, 50))] + [None, "a a a a a a a a"]
    for first, last, doc, words in W.word_hashes(texts):
        d, _, times = W.distinct_counts(*W.shingles(doc, words))
        for i in range(first, last):
            assert sorted(times[d == i - first]) == sorted(grams(texts[i] or "").values())


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000, i) for i in range(1001, 1400)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_lose_no_link_and_make_few_pairs(spark):
    """A chain whose neighbours alone are linked, all under one key: leaders find few links, the last round the rest."""
    nodes = spark.range(40).select(F.col("id").alias("node"), F.lit(7).cast("long").alias("key"))
    seen = []

    def verify(pairs):
        seen.append(pairs.count())
        return pairs.where("b - a = 1")

    got = {r.node: r.comp for r in link_groups(shared_keys(nodes), verify).collect()}
    assert got == dict.fromkeys(range(40), 0)
    alike = spark.range(3000).select(F.col("id").alias("node"), F.lit(7).cast("long").alias("key"))
    seen.clear()
    assert link_groups(shared_keys(alike), lambda p: verify_all(p, seen)).select("comp").distinct().count() == 1
    assert sum(seen) == 2999


def verify_all(pairs, seen):
    seen.append(pairs.count())
    return pairs


def test_probability_jaccard_and_signatures():
    rnd = np.random.default_rng(5)
    universe = W.mix(np.arange(400, dtype=np.uint64))
    sets = []
    for _ in range(6):
        at = np.sort(rnd.choice(400, 250, replace=False))
        order = np.argsort(universe[at])
        sets.append((universe[at][order], rnd.integers(1, 6, 250).astype(float)))
    doc = np.concatenate([np.full(len(e), i) for i, (e, _) in enumerate(sets)])
    held = minhash.prob_minhash(doc, np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets]), 6, 4096)
    for i, j in itertools.combinations(range(6), 2):
        a, b = (dict(zip(*s, strict=True)) for s in (sets[i], sets[j]))
        plain = sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in {*a, *b}) for x in {*a} & {*b})
        assert minhash.probability_jaccard(sets[i], sets[j]) == pytest.approx(plain)
        assert (held[i] == held[j]).mean() == pytest.approx(plain, abs=4 * math.sqrt(plain / 4096))
    one = np.ones(250)
    a, b = ({*sets[k][0].tolist()} for k in (0, 1))
    assert minhash.probability_jaccard((sets[0][0], one), (sets[1][0], one)) == pytest.approx(len(a & b) / len(a | b))


def near_rows():
    base = prose(11, 300)
    words = base.split(" ")
    rows = [(i, prose(100 + i, 80), "en", "a") for i in range(30)]
    for k in range(40):  # copies that differ in one to twelve words
        rnd = random.Random(k)
        edited = list(words)
        for _ in range(1 + k % 12):
            edited[rnd.randrange(300)] = f"z{rnd.randrange(99)}"
        rows.append((200 + k, " ".join(edited), "en", "b"))
    rows += [(300, base.upper(), "en", "b"), (301, rows[3][1] + "!", "en", "c"), (302, "short text", "en", "c"), (303, "Short text.", "en", "c")]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(table(spark, rows)).collect()}
    want = classes_by_brute_force(rows)
    assert got == want and len(set(want.values())) <= len(rows) - 20


def test_near_duplicates_edges(spark, edges, empty):
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in minhash.near_duplicates(edges).collect()), key=str)
    want = [(None, None, 1), (None, None, 1), (1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 3), (4, 4, 3), (5, 4, 3), (6, 6, 2), (7, 6, 2), (8, 8, 1)]
    assert got == sorted(want, key=str)
    kept = minhash.drop_near_duplicates(edges)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, None, 1, 2, 3, 4, 6, 8], key=str)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.drop_near_duplicates(empty).count() == 0


def test_containment(spark, edges, empty):
    items = [(i, prose(500 + i, n)) for i, n in enumerate((3, 6, 14, 30, 59, 200))] + [(None, None), (7, ""), (8, "?!"), (2, prose(502, 14))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    docs = []
    for k, (i, t) in enumerate(items[:6]):
        docs.append((k, prose(k, 5000) + " " + t + " " + prose(k + 50, 4000), "en", "a"))
        half = t.split(" ")
        docs.append((10 + k, prose(k, 100) + " " + " ".join(half[: len(half) // 2]), "en", "a"))
        nearly = list(half)
        nearly[0] = "changed"
        docs.append((20 + k, prose(k + 7, 900) + " " + " ".join(nearly) + " end", "en", "a"))
        docs.append((30 + k, t, "en", "a"))
    docs += [(90, None, None, None), (91, "", "en", "a"), (None, items[4][1], "en", "a"), (30, items[0][1], "en", "a")]
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contained_items(table(spark, docs), bench).collect()}
    want = {}
    for d, text, *_ in docs:
        for i, item in items:
            need = set(grams(item or ""))
            share = len(need & set(grams(text or "", min(5, len(tokens(item or "")) or 5)))) / len(need) if need else 0
            if share >= 0.8:
                want[d, i] = share
    assert got == want and len(want) > 12
    kept = decontaminate.drop_contaminated(table(spark, docs).withColumn("item_id", F.lit(5)), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, *_ in docs if d is not None and not any(x == d for x, _ in want))
    assert decontaminate.contained_items(empty, bench).count() == 0
    assert decontaminate.contained_items(edges, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(edges, bench.limit(0)).count() == edges.count()


def test_code_matrices():
    for n in (2, 3, 4, 7, 12, 30):
        code = language.code_matrix(n)
        assert min((code[a] != code[b]).sum() for a, b in itertools.combinations(range(n), 2)) >= max(1, 2 ** (min(n, 7) - 2) if n <= 7 else 8)
    assert language.code_matrix(4).shape == (4, 7)


def test_language(spark, sf_dir, edges, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", language.held_out())
    model = language.train(docs.where("not held_out"))
    found = language.identify(docs, model, ["doc_id", "held_out"]).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 30 and np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    got = language.identify(edges, model, ["doc_id", "text", "score"]).collect()
    assert len(got) == edges.count()
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in got)
    assert language.identify(empty, model, ["doc_id"]).count() == 0
    blank = language.train(empty)
    assert {r.lang_pred for r in language.identify(edges, blank, ["doc_id"]).collect()} == {"und"}
    assert language.keep_known(edges, model).columns == edges.columns
    single = language.train(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in language.identify(docs.limit(5), single, ["doc_id"]).collect()} == {"en"}


def test_language_ambiguity(spark):
    """A text that is half one language and half another is flagged, pure ones are not."""
    alphabet = {"p": "abcdefgh", "q": "ijklmnop"}
    rnd = random.Random(1)
    text = lambda lang, n: " ".join("".join(rnd.choice(alphabet[lang]) for _ in range(5)) for _ in range(n))
    docs = table(spark, [(i, text(lang, 50), lang, None) for i in range(40) for lang in "pq"])
    model = language.train(docs)
    mixed = table(spark, [(1, text("p", 400) + " " + text("q", 400), None, None), (2, text("p", 9), None, None)])
    got = {r.doc_id: (r.lang_pred, r.ambiguous) for r in language.identify(mixed, model, ["doc_id"]).collect()}
    assert got[1][1] and got[2] == ("p", False)


def test_quality(spark, edges, empty):
    rnd = random.Random(4)
    good = [(i, prose(i, 80), "en", "a") for i in range(200)]
    bad = [(1000 + i, " | ".join(f"x{rnd.randrange(9)}" for _ in range(80)), "en", "a") for i in range(120)]
    docs = table(spark, good + bad)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)] + [(1000, 0, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert 0.2 < model.prior < 0.75  # 100 of 220 unlabelled texts are good
    got = {r.doc_id: r for r in quality.score(docs, model, ["doc_id"]).collect()}
    assert np.mean([got[i].predicted == 1 for i, *_ in good]) > 0.95 and np.mean([got[i].predicted == 0 for i, *_ in bad]) > 0.95
    scored = quality.score(edges, model, ["doc_id", "score", "size"]).collect()
    assert len(scored) == edges.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    assert quality.score(empty, model, ["doc_id"]).count() == 0
    assert {r.score for r in quality.score(docs, quality.train(empty, labels), ["doc_id"]).collect()} == {0.5}


def test_prior_estimate():
    rnd = np.random.default_rng(1)
    positive, negative = rnd.normal(2, 1, 4000), rnd.normal(-2, 1, 2000)
    counts = lambda margins: np.bincount(quality.margin_bins(margins), minlength=quality.SCORE_BINS)
    assert quality.estimate_prior(counts(positive), counts(np.concatenate([rnd.normal(2, 1, 2000), negative]))) == pytest.approx(0.5, abs=0.08)


def test_quality_samples_are_bounded_with_null_and_equal_ids(spark):
    """Rows of one id, or of none, are drawn one by one; repeated rows come once, so the driver's sample stays bounded."""
    rows = [(None, prose(i, 20), None, None) for i in range(600)] + [(None, "the same text", None, None)] * 500 + [(7, prose(i, 20), None, None) for i in range(600, 1200)]
    docs = table(spark, rows).withColumn("__draw", quality._draw())
    assert 10 < len(quality._sample(docs, 100)) < 160 and len(quality._sample(docs, 10_000)) == 1201


def test_quality_prior_counts_every_measured_row(spark):
    docs = table(spark, [(i, prose(i, 30), "en", "a") for i in range(300)] + [(None, "again", None, None)] * 40)
    model = quality.QualityModel(0.5, np.zeros(quality.FEATURES), np.ones(quality.FEATURES), np.zeros((quality.FEATURES, quality.HIDDEN)), np.zeros(quality.HIDDEN), np.zeros(quality.HIDDEN), 1.0)
    p, u = quality._score_counts(docs.repartition(7), docs.where("doc_id < 50").select("doc_id"), model)
    at = quality.margin_bins(np.array([1.0]))[0]
    assert p.sum() == p[at] == 50 and u.sum() == u[at] == 290


def removed_lines_by_brute_force(docs, prints):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, e in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
            row = new
        return row[-1]

    where = defaultdict(list)
    for r in docs:
        where[r.norm].append((r.doc_id, r.line))
    names = list(where)
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(names, 2):
        longer = max(len(a), len(b))
        if (prints[a] ^ prints[b]).bit_count() <= 3 and distance(a, b) <= 0.2 * longer + 1e-9:
            parent[find(a)] = find(b)
    groups = defaultdict(list)
    for n, at in where.items():
        groups[find(n)] += at
    return sorted(x for at in groups.values() for x in sorted(at)[1:])


def test_lines_equal_brute_force(spark):
    rnd = random.Random(9)
    base = [" ".join(f"word{rnd.randrange(400)}" for _ in range(40)) for _ in range(12)]
    rows = []
    for i in range(40):
        text = []
        for line in rnd.sample(base, 4):
            words = line.split(" ")
            if rnd.random() < 0.7:
                words[rnd.randrange(40)] = f"other{rnd.randrange(50)}"
            text.append(" ".join(words))
        rows.append((i, "\n".join([*text, "", "Page 1 of 2", " ".join(f"u{rnd.randrange(9999)}" for _ in range(9))]), "en", "a"))
    docs = table(spark, rows)
    marked = lines.fingerprint(lines._lines(docs).withColumn("norm", F.array_join("words", " ")), ["doc_id", "line", "norm"], "words", "size").collect()
    want = removed_lines_by_brute_force(marked, {r.norm: r.fp % (1 << 64) for r in marked})
    out = lines.drop_repeated_lines(docs).collect()
    assert sorted((r.doc_id, x) for r in out for x in r.removed or []) == want and len(want) > 60
    texts = {i: t for i, t, *_ in rows}
    for r in out:
        assert r.text == "\n".join(x for k, x in enumerate(texts[r.doc_id].split("\n")) if k not in (r.removed or []))
        assert r.lines == 7


def test_wide_search_finds_what_edit_similarity_links(spark):
    """Recall of planted lines of 2 to 100 words against edit similarity alone; without the wide search most stay."""
    rnd = random.Random(4)

    def word():
        return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(3, 9)))

    def typo(text):
        at = rnd.randrange(len(text))
        return text[:at] + rnd.choice("abcdefghijklmnopqrstuvwxyz") + text[at + 1 :]

    texts = []
    for size in (2, 5, 10, 20, 27, 40, 100):
        for turn in range(12):
            first = [word() for _ in range(size)]
            other = list(first)
            if turn % 2 or size < 10:
                texts.append((" ".join(first), typo(" ".join(first))))
            else:
                for at in rnd.sample(range(size), max(1, size // (10 if turn % 4 else 20))):
                    other[at] = word()
                texts.append((" ".join(first), " ".join(other)))
    rows = [(2 * i + k, t, "en", "a") for i, pair in enumerate(texts) for k, t in enumerate(pair)]
    pairs = spark.createDataFrame([(2 * i + 1, a, b) for i, (a, b) in enumerate(texts)], "i long, a string, b string")
    alike = "levenshtein(a, b) <= 0.2D * greatest(length(a), length(b)) + 1e-9D"
    want = {r.i for r in pairs.where(alike).collect()}
    removed = {wide: {r.doc_id for r in lines.drop_repeated_lines(table(spark, rows), wide=wide).collect() if r.removed} for wide in (False, True)}
    print("planted", len(want), "narrow", len(removed[False]), "wide", len(removed[True]))
    assert removed[True] <= want and len(want) > 75
    assert len(removed[True]) >= 0.95 * len(want) > 2 * len(removed[False])


def test_windows_are_runs_whatever_their_place(spark):
    """Short lines without a common letter share no window; words put before a line leave its other windows."""
    long = " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40))
    texts = ["abcdefg", "hijklmn", "xyabcdefg", "abcdefghij" * 5, "klmnopqrst" * 5, long, "one two " + long]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    found = {r.length: set(r.windows) for r in lines._windows(table(spark, rows[:1] + rows[2:4] + rows[5:])).collect()}
    other = {r.length: set(r.windows) for r in lines._windows(table(spark, [rows[1], rows[4]])).collect()}
    assert not found[7] & other[7] and not found[50] & other[50]
    assert len(found[7] & found[9]) == 3
    assert len(found[len(long)]) == lines.WINDOWS and len(found[len(long)] & found[len(long) + 8]) >= lines.WINDOWS - 3


def test_short_lines_lose_no_link(spark):
    """Every pair of lines of up to 14 letters with similarity 0.8 shares a key, by brute force."""
    rnd = random.Random(9)
    texts = {"la ja", "la ra"}
    for size in range(1, 15):
        for _ in range(12):
            text = [rnd.choice("abcdefghij") for _ in range(size)]
            texts.add("".join(text))
            for _ in range(2):
                other, edits = list(text), rnd.randrange(1, 3)
                for _ in range(edits):
                    at, letter = rnd.randrange(len(other) + 1), rnd.choice("abcdefghij")
                    other[at : at + rnd.randrange(2)] = rnd.choice(([letter], [], [letter]))
                texts.add("".join(other))
    texts = sorted(t for t in texts if 0 < len(t) <= 14)
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    keys = lines._windows(docs).join(lines._lines(docs).select("doc_id", F.col("h").alias("node")), "node").select("doc_id", "windows").persist()
    found = {r.doc_id: set(r.windows) for r in keys.collect()}
    named = docs.select("doc_id", "text").alias("l").join(docs.select("doc_id", "text").alias("r"), F.expr("l.doc_id < r.doc_id"))
    alike = named.where("levenshtein(l.text, r.text) <= 0.2D * greatest(length(l.text), length(r.text)) + 1e-9D").select(F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b")).collect()
    assert len(alike) > 150 and all(found[r.a] & found[r.b] for r in alike)


def test_no_pair_is_verified_twice(spark):
    """Pairs that a leader was refused in are not verified again, and no link is lost by that."""
    members = spark.createDataFrame([(7, n) for n in range(1, 9)], "key long, node long")
    seen = []

    def verify(pairs):
        seen.extend((r.a, r.b) for r in pairs.collect())
        return pairs.where("a % 4 = b % 4 and a > 2")

    comps = {r.node: r.comp for r in link_groups(members, verify).collect()}
    assert comps == {3: 3, 7: 3, 4: 4, 8: 4}
    assert len(seen) == len(set(seen)) and {(3, 7), (4, 8)} <= set(seen)


def test_letters_lose_no_link(spark):
    """Short lines of similarity 0.8 pass the letter counts, by brute force; most others do not."""
    rnd = random.Random(12)
    texts = set()
    for size in (1, 3, 9, 20, 45, 78):
        for _ in range(6):
            text = [rnd.choice("abcdefghijklmnopqrstuvwxyz   é0ßñ") for _ in range(size)]
            texts.add("".join(text))
            other = list(text)
            for _ in range(size // 5):
                at = rnd.randrange(len(other) + 1)
                other[at : at + rnd.randrange(2)] = rnd.choice(([rnd.choice("aez 0é")], [], ["a"]))
            texts.add("".join(other))
    texts |= {"a" * 60, "a" * 50, "b" * 60}
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(sorted(texts))])
    counted = lines._windows(docs).select("length", "norm", *[F.col("letters")[i].alias(f"l{i}") for i in range(6)]).where("length <= 80").persist()
    pairs = counted.alias("l").join(counted.alias("r"), F.expr("l.norm < r.norm"))
    alike = F.expr("levenshtein(l.norm, r.norm) <= 0.2D * greatest(l.length, r.length) + 1e-9D")
    found = pairs.select(alike.alias("alike"), lines._letters_allow("l", "r", 0.8).alias("allowed")).collect()
    assert sum(r.alike for r in found) > 20 and all(r.allowed for r in found if r.alike)
    assert sum(r.allowed for r in found) < len(found) / 4


def test_fingerprint_is_the_majority(spark):
    rnd = random.Random(3)
    rows = [(i, [f"w{i}_{k}" for k in range(n)]) for i, n in enumerate((0, 1, 2, 3, 15, 16, 63, 64, 126, 127, 128, 253, 254, 255, 1500, 32767, 32768, 70000))]
    df = spark.createDataFrame(rows, "i int, words array<string>")
    hashes = {r.i: r.h for r in df.select("i", F.transform("words", lambda w: F.xxhash64(w)).alias("h")).collect()}
    prints = lines.fingerprint(df.union(df.where("i < 3")).withColumn("size", 2 * F.size("words")), ["i"], "words", "size").collect()
    assert sorted(r.i for r in prints) == sorted([1, 2, *range(1, 18)])
    for r in prints:
        want = sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in hashes[r.i]) > len(hashes[r.i]))
        assert r.fp % (1 << 64) == want


def test_lines_edges(spark, edges, empty):
    out = lines.drop_repeated_lines(edges).collect()
    assert len(out) == edges.count()
    kept = {(r.doc_id, r.text) for r in out}
    assert (1, None) in kept and (2, "") in kept and (3, "!!! ...") in kept and (5, "") in kept and (7, "") in kept
    assert sum(r.doc_id == 4 and r.text == prose(4, 60) for r in out) == 2
    assert lines.drop_repeated_lines(empty).count() == 0


def removed_sentences_by_brute_force(rows):
    occurrences, sizes = defaultdict(set), {}
    for i, text, *_ in rows:
        if not text:
            continue
        parts = [tuple(tokens(p)) for p in re.split(r"(?<=[.!?])(?=\s)|(?<=\n)", text)]
        parts = [p for p in parts if p]
        sizes[i] = len(parts)
        for a in range(len(parts)):
            for b in range(a + 2, len(parts) + 1):
                if sum(map(len, parts[a:b])) >= 10:
                    occurrences[tuple(parts[a:b])].add((i, a, b))
                    break
            if len(parts[a]) >= 20:
                occurrences["one", parts[a]].add((i, a, a + 1))
    gone = defaultdict(set)
    for at in occurrences.values():
        for i, a, b in sorted(at)[1:]:
            gone[i].update(range(a, b))
    return {i: sorted(s) for i, s in gone.items()}, sizes


def test_spans_equal_brute_force(spark, monkeypatch):
    passage = ["The one passage that is in many texts comes here. It has some sentences! Are they found? We hope that they are."] * 3
    rows = [(i, prose(i, 60) + ("\n" if i % 2 else " mid ") + passage[0] + " " + prose(i + 900, 30), "en", "a") for i in range(12)]
    rows += [(50, prose(70, 200), "en", "a"), (51, "again and again. " * 30, "en", "a"), (52, "One two. Three.", "en", "a"), (53, "One two. Three.", "en", "a")]
    want, sizes = removed_sentences_by_brute_force(rows)
    out = {r.doc_id: r for r in spans.drop_repeated_spans(table(spark, rows)).collect()}
    assert {i: list(r.removed) for i, r in out.items() if r.removed} == want and len(want) >= 12
    assert all(out[i].sentences == n for i, n in sizes.items())
    assert out[0].text == rows[0][1] and "Are they found" not in out[3].text and out[53].text == "One two. Three."
    whole = spans.sentences(rows[0][1])
    monkeypatch.setattr(W, "PIECE_CHARS", 40)
    assert all((a == b).all() for a, b in zip(whole, spans.sentences(rows[0][1]), strict=True))


def test_spans_cover_repeated_runs_to_their_last_sentence(spark):
    """Brute force over runs of every length; 17, 10, 1, 5 and 3 words lose their last two sentences by starts alone."""

    def text(seed, sizes):
        rnd = random.Random(seed)
        return "".join(" ".join(f"v{rnd.randrange(10**6)}" for _ in range(n)) + ". " for n in sizes)

    shared = text(1, (17, 10, 1, 5, 3))
    rows = [(i, text(10 + i, (8, 14)) + shared + text(50 + i, (6, 12)), "en", "a") for i in range(3)]
    rows += [(i, text(2, (4, 9, 2, 3, 1)), "en", "a") for i in (10, 11)]
    rnd = random.Random(5)
    parts = [text(100 + k, (rnd.randrange(1, 14),)) for k in range(12)]
    rows += [(20 + i, "".join(rnd.choice(parts) for _ in range(15)), "en", "a") for i in range(12)]
    occurrences = defaultdict(set)
    for i, t, *_ in rows:
        p = [tuple(tokens(x)) for x in t.split(". ") if x]
        for a, b in itertools.combinations(range(len(p) + 1), 2):
            if b - a >= 2 and sum(map(len, p[a:b])) >= 10:
                occurrences[tuple(p[a:b])].add((i, a, b))
    want = defaultdict(set)
    for at in occurrences.values():
        for i, a, b in sorted(at)[1:]:
            want[i].update(range(a, b))
    out = {r.doc_id: r for r in spans.drop_repeated_spans(table(spark, rows)).collect()}
    assert {i: list(r.removed) for i, r in out.items() if r.removed} == {i: sorted(x) for i, x in want.items()}
    assert list(out[1].removed) == [2, 3, 4, 5, 6] and out[11].text == ""


def test_spans_edges(spark, edges, empty):
    out = spans.drop_repeated_spans(edges).collect()
    assert len(out) == edges.count()
    kept = {(r.doc_id, r.text) for r in out}
    assert (1, None) in kept and (2, "") in kept and (7, "") in kept and (8, "x") in kept
    assert sum(r.doc_id == 4 and r.text == prose(4, 60) for r in out) == 2
    assert spans.drop_repeated_spans(empty).count() == 0


def test_mixing(spark):
    rnd = random.Random(8)
    rows = [(i, prose(i, rnd.randrange(1, 90)), "en", rnd.choice(["a", "b", "b", "c", "c", "c", "d", None, "é"])) for i in range(1500)]
    rows += [(5000, None, "en", "a"), (5001, "", "en", "z"), (5002, "tiny", "en", "y")]
    docs = table(spark, rows).withColumns({"taken": F.lit("clash"), "u": F.lit(0)})
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(sizes)
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert all(r.target == pytest.approx(want[s]) and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max([r.size for r in mine] or [0]) / 2 + 1e-6
    assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in out)
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert {(r.doc_id, r.taken) for r in out} == {(r.doc_id, r.taken) for r in again}
    mixed, weighed = mixing.mixed_rows(docs), mixing.mix_by_length(docs).collect()
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in weighed)
    for s in sizes:
        mine = [r for r in weighed if r.source == s]
        assert abs(sum(r.taken for r in mine) - want[s]) <= max([r.size for r in mine] or [0]) / 2 + 1e-6


def test_mixing_draws_equal_rows_exactly_in_any_layout(spark):
    """The cut falls among repeated rows: what is taken is within half a row of the target, whatever the layout."""
    rows = [(1, "one two three", "en", "a")] * 6000 + [(2, "four five", "en", "b")] * 900 + [(i, prose(i, 40), "en", "b") for i in range(3, 60)]
    rows += [(None, "no id at all", None, None)] * 2000
    seen = set()
    for parts in (1, 2, 5):
        out = mixing.mix_by_length(table(spark, rows).repartition(parts, F.rand(parts)), weights=(4, 1, 2)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("rows")).collect()
        assert sum(r.rows for r in out) == len(rows) and all(abs(r.taken - r.target) <= {"a": 1.5, None: 2.0}.get(r.source, 20) for r in out)
        seen.add(tuple(sorted((r.source or "", r.taken) for r in out)))
    assert len(seen) == 1


def test_longer_documents_are_likelier_in_the_mix(spark):
    rows = [(i, " ".join(["w"] * (10 if i % 2 else 100)), "en", "ab"[i % 4 // 2]) for i in range(4000)]
    out = mixing.mix_by_length(table(spark, rows), weights=(3, 1)).where("source = 'b'").groupBy("size").agg(F.avg("copies").alias("c")).collect()
    share = {r["size"]: r.c for r in out}
    assert share[100] > 2 * share[10] > 0


def test_mixing_with_inclusion_weights(spark):
    docs = table(spark, [(i, "one two three", "en", "ab"[i % 2]) for i in range(4000)]).withColumn("wish", F.when(F.col("doc_id") % 4 < 2, 3.0).otherwise(1.0))
    out = mixing.mix_sources(docs, weights=(3, 1), inclusion="wish").where("source = 'b'").groupBy((F.col("doc_id") % 4 < 2).alias("liked")).agg(F.avg("copies").alias("c")).collect()
    share = {r.liked: r.c for r in out}
    assert share[True] > 2 * share[False] > 0 and (share[True] + share[False]) / 2 == pytest.approx(0.5, abs=0.002)


def test_mixing_edges(spark, edges, empty):
    out = mixing.mix_sources(edges.drop("size")).collect()
    assert len(out) == edges.count() and all(r.taken <= 3 * r.size for r in out)
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


@pytest.mark.parametrize("limit", [300, 5000, 10**9])
def test_sharding(spark, edges, limit):
    rows = [(i, prose(i, 1 + i % 40), "en", "a") for i in range(800)] + [(7, "copy of one row", "en", "a")] * 400 + [(None, None, None, None)] * 3
    docs = table(spark, rows).withColumns({"shard": F.lit(1), "prefix": F.lit(2)})
    out = sharding.assign_shards(docs, limit).cache()
    assert out.count() == len(rows) and set(docs.columns) <= {*out.columns}
    groups = out.groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"), F.max("bytes").alias("most")).collect()
    assert all(g.bytes <= limit or g.docs == 1 for g in groups)
    size = defaultdict(int)
    for g in groups:
        depth, prefix, *numbered = (int(x) for x in g.shard.split("-"))
        assert not numbered or depth == 63  # only repeated rows are counted off
        size[depth, prefix] += g.bytes
    ends = sorted((p << (63 - d), (p + 1) << (63 - d)) for d, p in size)
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(ends))
    # only buckets that are too large split: siblings together would not fit
    assert all(size[d, p] + size[d, p ^ 1] > limit for d, p in size if d and (d, p ^ 1) in size)
    out.unpersist()


@pytest.mark.parametrize("limit", [200, 2000, 1 << 20])
def test_sharding_loses_no_row_of_shuffled_input_with_repeats(spark, limit):
    """Repeated rows, rows of one id, null ids and one large row; the input comes from a shuffle, in three layouts."""
    rows = [(i % 90, prose(i % 130, 1 + i % 25), "en", "a") for i in range(2000)] + [(5, "again and again", "en", "a")] * 900
    rows += [(None, "no id", None, None)] * 500 + [(None, prose(i, 9), None, None) for i in range(300)] + [(6, prose(6, 900), "en", "a")] * 2
    seen = []
    for parts in (1, 3, 16):
        docs = table(spark, rows).repartition(parts, F.rand(parts))
        out = sharding.assign_shards(docs, limit, identity=["doc_id"]).cache()
        assert sorted(map(repr, out.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
        groups = out.groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs")).collect()
        assert all(g.bytes <= limit or g.docs == 1 for g in groups)
        seen.append(sorted((r.doc_id is None, r.doc_id or 0, r.text, "-".join(r.shard.split("-")[:2])) for r in out.collect()))
        out.unpersist()
    assert seen[0] == seen[1] == seen[2]


def test_sharding_edges(spark, edges, empty):
    out = sharding.assign_shards(edges, 1000)
    assert out.count() == edges.count()
    assert sharding.assign_shards(empty).count() == 0
    path = scratch_path(spark, "shards")
    sharding.write_shards(out, path)
    assert spark.read.parquet(path).count() == edges.count()


def test_top_k(spark):
    rnd = np.random.default_rng(3)
    values = rnd.integers(-40, 40, (700, 8))
    values[100:300] = values[7]  # ties
    rows = [(int(i), [float(x) / 1024 for x in v]) for i, v in enumerate(values)]
    rows += [(800, None), (900, [float("nan")] * 8), (1000, [None] * 8), (1100, [float("inf")] * 8), (None, [0.0] * 8), (1200, [0.5] * 3), (1201, [0.25] * 3), (7, rows[7][1]), (1300, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.quantized().alias("vector"))
    queries = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    got = defaultdict(list)
    for r in topk.exact_top_k(vectors, queries, block_rows=64, query_rows=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    usable = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if v is not None and i is not None and None not in v and np.isfinite(v).all()]
    for q, x in usable:
        if q % 100 == 0:
            scores = sorted((-int(x @ y), i) for i, y in usable if i != q and len(y) == len(x))[:10]
            assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert {q for q, v in got.items() if v} == {q for q, _ in usable if q % 100 == 0} - {1300}
    assert topk.exact_top_k(vectors.limit(0), queries).count() == 0 and topk.exact_top_k(vectors, queries.limit(0)).count() == 0


def test_top_k_stops_early():
    rnd = np.random.default_rng(3)
    rows = rnd.integers(-1000, 1000, (4000, 3))
    rows[5] = 5000
    query = np.array([[5, 4, 3]])
    at_query, at_row = topk.no_random_access(query, np.array([-1]), rows, np.arange(4000), 1)
    assert 5 in at_row and len(at_row) <= 2


def archive(spark, pages, least=0):
    path = scratch_path(spark, "warc")
    warc.write_archives(pages, path, least)
    return path


def test_warc_round_trip_with_magic_inside(spark):
    trap = "text WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"
    rows = [(1, "http://a", "<p>ü</p>"), (2, "http://b\r\nEvil: 1", trap), (3, None, None), (4, "", ""), (5, "u", "<p>ü</p>"), (6, "u", trap * 50), (6, "v", "twice"), (6, "v", "twice"), (None, "n", "no id"), (7, "w", trap)]
    rows += [(100 + i, "x", f"page {i} " + trap * (i % 3)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("payload", F.lit("clash"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        path = archive(spark, pages)
        found = warc.read_archives(spark, path, with_payload=True).collect()
        light = warc.read_archives(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    key = lambda r: (str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to))
    planned = warc.plan_records(pages).collect()
    assert sorted(map(key, found)) == sorted(map(key, planned)) == sorted(map(key, light))
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in planned}
    assert {(1, "revisit", 5), (5, "response", None), (3, "revisit", 4), (4, "response", None), (2, "revisit", 7), (6, "response", None), (None, "response", None)} <= kinds
    text = {r.page_id: bytes(r.payload).decode() for r in found if r.record_type == "response" and r.page_id is not None and r.page_id != 6}
    assert text[7] == trap and text[5] == "<p>ü</p>" and text[102] == "page 2 " + trap * 2


def test_warc_threshold_and_empty(spark):
    pages = spark.createDataFrame([(1, "a", "abc"), (2, "b", "abc"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.read_archives(spark, archive(spark, pages, least=5)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.read_archives(spark, archive(spark, pages.limit(0))).count() == 0
