"""Vector codes against brute force, the GNAT against all distances, and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def codes_by_brute_force(rows, parts=4, entries=256, rounds=4):
    """Plain Python over rows (vec_id, embedding, label) of one length."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = len(min(kept)[1])
    width = -(-dims // parts)
    cut = [[(v + [0] * parts)[p * width : (p + 1) * width] if dims % parts == 0 else (v + [0] * (width * parts - dims))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0], kept[r][1]))[:entries]
    books = [[cut[r][p] for r in order] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for row in cut:
                members[nearest(row[p], books[p])[1]].append(row[p])
            for e, mine in members.items():
                books[p][e] = [sum(xs) // len(mine) for xs in zip(*mine, strict=True)]
    labels, out = defaultdict(int), []
    for (i, _, label), row in zip(kept, cut, strict=True):
        hits = [nearest(row[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in hits)
        labels[label] += error
        out.append((i, label, "".join(f"{e:02x}" for _, e in hits), error))
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted((i, code, error, labels[label], digest) for i, label, code, error in out)


def got(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"code": F.lit("mine"), "error": F.lit(1), "part": F.lit(0)})
    out = codes.compress(frame.withColumn("vector", codes.quantized()), **options)
    return sorted(tuple(r) for r in out.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def cloud(seed, rows, dims, centres=9):
    rnd = random.Random(seed)
    middle = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [(i, [x + rnd.gauss(0, 0.1) for x in middle[rnd.randrange(centres)]], rnd.choice([0, 1, None])) for i in range(rows)]


@pytest.mark.parametrize(("dims", "entries"), [(8, 16), (12, 7)])
def test_compress_equals_brute_force(spark, dims, entries):
    rows = cloud(1, 150, dims)
    random.Random(2).shuffle(rows)
    assert got(spark, rows, entries=entries) == codes_by_brute_force(rows, entries=entries)


@pytest.mark.parametrize(("seed", "spread", "width"), [(1, 3, 2), (2, 1000, 5), (3, 1 << 25, 16), (4, 1, 3)])
def test_gnat_equals_all_distances_with_ties(seed, spread, width):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-spread, spread + 1, (256, width))
    entries[200:] = entries[rng.integers(0, 200, 56)]  # equal entries: the first is the answer
    queries = np.concatenate([rng.integers(-spread, spread + 1, (400, width)), entries[:50], (entries[:40] + entries[40:80]) // 2])
    apart = ((queries[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
    number, best = codes.Gnat(entries).nearest(queries)
    assert best.tolist() == apart.min(1).tolist()
    assert number.tolist() == [list(row).index(min(row)) for row in apart]


def test_gnat_leaves_subtrees_out():
    rng = np.random.default_rng(7)
    centres = rng.integers(-100_000, 100_000, (20, 8))
    entries = centres[rng.integers(0, 20, 256)] + rng.integers(-50, 50, (256, 8))
    queries = centres[rng.integers(0, 20, 1000)] + rng.integers(-50, 50, (1000, 8))
    tree = codes.Gnat(entries)
    tree.nearest(queries)
    assert tree.compared < 0.4 * 256 * 1000


def test_exclusion_keeps_entries_at_the_best_distance():
    """Entries on a circle around the query: all at the same distance, the first must be found."""
    points = [(x, y) for x in range(-65, 66) for y in range(-65, 66) if x * x + y * y == 65 * 65]
    for turn in range(len(points)):
        entries = np.array(points[turn:] + points[:turn])
        number, best = codes.Gnat(entries, degree=3, leaf=2).nearest(np.zeros((1, 2), np.int64))
        assert number[0] == 0 and best[0] == 65 * 65


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 2.0, -3.5, 0.25], 1), (1, [1.0, 2.0, -3.5, 0.25], None), (5, [1.0, 2.0, -3.5, 0.25], 1), (2, None, 1), (3, [1.0, None, 0.0, 0.0], 1), (4, [nan, 0.0, 0.0, 0.0], 1), (6, [0.0, inf, 0.0, 0.0], 2), (7, [-0.0001, 9.0, 9.0, 9.0], None)]
    assert got(spark, rows) == codes_by_brute_force(rows)
    with_null = [*rows, (None, [0.5, 0.5, 0.5, 0.5], 3)]
    out = spark.createDataFrame(with_null, SCHEMA).withColumn("vector", codes.quantized())
    assert codes.compress(out).count() == 5
    # vectors of another length than the first one's take no part, whatever they hold
    assert got(spark, [*rows, (50, [1.0], 1), (51, [], 1)]) == codes_by_brute_force(rows)
    assert got(spark, [(1, None, 1)]) == [] and got(spark, []) == []
    large = [(1, [1e300, -1e300, 3.0, 4.0], 1), (2, [0.0, 0.0, 0.0, 0.0], 1)]
    assert [r[2] for r in got(spark, large)] == [0, 0]
    assert [(r[1], r[2]) for r in got(spark, [(1, [], 1), (2, [], 1)])] == [("00000000", 0)] * 2


def test_codes_are_read_back(spark):
    rows = cloud(4, 60, 10)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("vector", codes.quantized())
    books = codes.train_codebooks(frame, entries=300)  # more entries than rows: every row is an entry at first
    out = codes.decode(codes.encode(frame, books), books).collect()
    whole = {r.vec_id: r.vector for r in frame.collect()}
    assert len(out) == 60 and all(sum((a - b) ** 2 for a, b in zip(r.vector, whole[r.vec_id], strict=True)) == r.error for r in out)
