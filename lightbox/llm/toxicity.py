"""Toxicity scores by non-negative positive-unlabelled learning.

Words and word beginnings that confirmed toxic documents use far more often than
documents at large form a lexicon; its weights are shrunk log ratios of document
frequencies. Four features of a document's lexicon matches go to a linear scorer
fitted with the class-prior-corrected risk. Nothing but the text enters a score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightbox.llm.batches import pieces, whole_row
from lightbox.llm.pu_learning import (
    LinearScorer, collect_features, fit_nnpu, held_out, score_documents, training_sample,
)

FOLDS, HELD_OUT_FOLD = 4, 2
THRESHOLD = 0.3
MAX_POSITIVES, MAX_UNLABELLED = 4_000, 8_000
# Bytes of the word beginnings that count as terms beside whole words.
BEGINNINGS = (5, 6, 7, 8)
MIN_DOCUMENTS, MIN_Z, MIN_RATIO, MAX_TERMS = 3, 5.0, 4.0, 5_000
WIDTH = 4
REMEMBERED = 200_000
# Lower-case A-Z; other ASCII outside 0-9 and a-z separates words, everything else belongs to them.
TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else (c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256)
)


def terms(text: bytes | None) -> set[bytes]:
    """Words of a text, and their beginnings marked with a caret."""
    words = set((text or b"").translate(TO_WORDS).split())
    return words | {b"^" + w[:n] for w in words for n in BEGINNINGS if len(w) > n}


def lexicon(sample: DataFrame) -> dict[bytes, float]:
    """Term weights: log ratios of document frequencies, toxic against at large.

    Only terms of at least ``MIN_DOCUMENTS`` toxic documents whose frequencies
    differ by ``MIN_Z`` standard errors and by the factor ``MIN_RATIO``; the
    ``MAX_TERMS`` clearest, so that the list is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            for text, mark in zip(texts, batch.column("positive").to_pylist()):
                found = list(terms(text))
                yield pa.record_batch({
                    "term": pa.array(found, pa.binary()), "p": pa.array([int(mark)] * len(found), pa.int64()),
                })

    sizes = sample.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).first()
    n_p, n_u = max(sizes["p"], 1), max(sizes["u"], 1)
    df = sample.mapInArrow(run, "term binary, p long").groupBy("term").agg(
        F.sum("p").alias("p"), F.sum(1 - F.col("p")).alias("u")
    ).where(F.col("p") >= MIN_DOCUMENTS)
    share = (F.col("p") + F.col("u")) / (n_p + n_u)
    spread = F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    z = F.when(spread > 0, (F.col("p") / n_p - F.col("u") / n_u) / spread).otherwise(0.0)
    ratio = ((F.col("p") + 0.5) / (n_p + 1)) / ((F.col("u") + 0.5) / (n_u + 1))
    rows = (
        df.select("term", z.alias("z"), ratio.alias("ratio")).where((F.col("z") >= MIN_Z) & (F.col("ratio") > MIN_RATIO))
        .orderBy(F.desc("z"), "term").limit(MAX_TERMS).collect()
    )
    return {bytes(r["term"]): math.log(r["ratio"]) for r in rows}


def feature_function(weights: dict[bytes, float]) -> Callable[[list[bytes | None]], np.ndarray]:
    """Features of a batch of texts: how many matches, their weight, the largest, their density."""

    memory: dict[bytes, tuple[float, ...]] = {}

    def features(texts: list[bytes | None]) -> np.ndarray:
        get = weights.get

        def matches(word: bytes) -> tuple[float, ...]:
            if len(memory) >= REMEMBERED:
                memory.clear()
            begins = [get(b"^" + word[:n], 0.0) for n in BEGINNINGS if len(word) > n]
            found = tuple(x for x in (get(word, 0.0), max(begins, default=0.0)) if x)
            memory[word] = found
            return found

        out = np.zeros((len(texts), WIDTH))
        for i, text in enumerate(texts):
            words = (text or b"").translate(TO_WORDS).split()
            recall = memory.get
            hits = [x for w in words if (m := recall(w) if w in memory else matches(w)) for x in m]
            total = sum(hits)
            out[i] = (
                math.log1p(len(hits)), math.log1p(total), max(hits, default=0.0),
                math.log1p(1000 * total / (len(words) + 20)),
            )
        return out

    return features


@dataclass
class ToxicityModel:
    weights: dict[bytes, float]
    scorer: LinearScorer


def train(
    docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT_FOLD,
    max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED,
) -> ToxicityModel:
    """Fit on at most ``max_positives`` confirmed toxic and ``max_unlabelled`` other documents.

    Labels of the held-out fold are never read. Without toxic labels every
    score is the class prior.
    """
    sample, prior = training_sample(docs, labels, "toxic", folds, fold, max_positives, max_unlabelled)
    weights = lexicon(sample)
    positive, unlabelled = collect_features(sample, feature_function(weights), WIDTH)
    return ToxicityModel(weights, fit_nnpu(positive, unlabelled, prior))


def toxicity(docs: DataFrame, model: ToxicityModel, folds: int = FOLDS, fold: int = HELD_OUT_FOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null and empty texts have no match."""
    scored = score_documents(docs.select("doc_id", "text"), feature_function(model.weights), model.scorer)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    rows = docs.select(whole_row(docs))
    scored = score_documents(rows, feature_function(model.weights), model.scorer, "row.text")
    return scored.where(F.col("score") < threshold).select("row.*")
