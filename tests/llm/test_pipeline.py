"""The pipeline's stages against brute force on their own inputs, and their edge cases."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
import pytest
from corpus_helpers import DOCS, classes_by_brute_force, edge_rows, grams, plain_targets, table
from pyspark.sql import functions as F

from foldwright.llm import sharding

@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """The input and output of each stage."""
    folder, docs, found = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        found[name] = docs.collect(), after.collect(), after.columns
        docs = after
    return found


def test_columns(steps):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert all(steps[n][2] == ["doc_id", "text", "lang", "source", "n_chars"] for n in names[:-1])
    assert steps[names[-1]][2][-2:] == ["shard", "bytes"]


def test_language_keeps_clean_documents(steps):
    before, after, _ = steps["language_id"]
    assert {r.doc_id for r in before if re.search(r"[^\W\d_]", r.text or "")} - {r.doc_id for r in after} == set()


def test_near_dedup(steps):
    before, after, _ = steps["near_dedup"]
    classes = classes_by_brute_force([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(set(classes.values()))


def test_decontamination(spark, sf_dir, steps):
    before, after, _ = steps["decontamination"]
    items = [set(grams(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in before if any(len(i & set(grams(r.text))) >= 0.8 * len(i) for i in items)}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - bad and bad


def test_mixing(steps):
    before, after, _ = steps["mixing"]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in before:
        sizes[r.source] += words(r.text)
        most[r.source] = max(most[r.source], words(r.text))
    for r in after:
        taken[r.source] += words(r.text)
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= most[source] / 2 + 1e-6
    assert max(Counter(r.doc_id for r in after).values()) <= 3


def test_sharding(steps):
    before, after, _ = steps["sharding"]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    sums, rows = Counter(), Counter()
    for r in after:
        assert r.bytes == len((r.text or "").encode())
        sums[r.shard] += r.bytes
        rows[r.shard] += 1
    assert all(b <= sharding.LIMIT_BYTES or rows[s] == 1 for s, b in sums.items())


def test_run_equals_the_stages(spark, sf_dir, steps):
    got = Counter((r.doc_id, r.shard, r.bytes) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == Counter((r.doc_id, r.shard, r.bytes) for r in steps["sharding"][1])


@pytest.mark.parametrize("stage", range(5))
def test_stage_edges(spark, sf_dir, stage):
    step = corpus_pipeline.STAGES[stage][1]
    docs = table(spark, edge_rows()).withColumns({"key": F.lit(1), "lang_pred": F.lit("x"), "bits": F.lit(0), "item": F.lit(2)})
    out = step(spark, docs, sf_dir)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() <= 3 * docs.count()
    assert step(spark, spark.createDataFrame([], DOCS), sf_dir).count() == 0
