"""The pipeline against brute force over each stage's own input, and every query with SQL."""

import os
import re

import pytest

import corpus_pipeline
from lightbox.llm import toxicity
from lightbox.llm.queries import CHECKS, QUERIES
from tests.llm.test_corpus import near_labels, squeezed, words
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_check(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), CHECKS[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - CHECKS.keys()))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    phrases = {tuple(w[i : i + 10]) for w in bench for i in range(max(1, len(w) - 9)) if w}
    frames, current = [docs], docs
    for _, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, SF).cache()
        frames.append(current)
    assert all(f.columns == docs.columns for f in frames[1:-1])
    ids = [sorted(r.doc_id for r in f.select("doc_id").collect()) for f in frames]
    text = {r.doc_id: r.text for r in docs.collect()}

    scores = toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()
    assert ids[1] == sorted(r.doc_id for r in scores if r.predicted == 0)

    groups = {}
    for d in ids[1]:
        groups.setdefault(squeezed(text[d]), []).append((-len(text[d]), d))
    assert ids[2] == sorted(min(g)[1] for g in groups.values())

    assert ids[3] == [ids[2][i] for i in sorted(set(near_labels([text[d] for d in ids[2]])))]

    def leaks(t):
        w = words(t)
        return any(tuple(w[i : i + len(p)]) == p for p in phrases for i in range(len(w) - len(p) + 1) if w[i] == p[0])

    assert ids[4] == [d for d in ids[3] if not leaks(text[d])]
    assert ids[5] == ids[4]
    for r in frames[5].collect():
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])) and r.taken <= 3 * r.size


def test_empty(spark):
    """No documents in, none out, whatever the stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
