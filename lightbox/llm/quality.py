"""Text quality by positive-unlabelled learning.

The shape of a text (classes of bytes, word lengths, repetition) goes to a linear
scorer fitted from trusted good documents and unlabelled web text with the
non-negative risk. Nothing but the text enters a score.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightbox.llm.pu_learning import (
    LinearScorer, collect_features, fit_nnpu, held_out, score_documents, training_sample,
)

FOLDS, HELD_OUT_FOLD = 5, 0
THRESHOLD = 0.3
MAX_POSITIVES, MAX_UNLABELLED = 4_000, 8_000
MARKS = b"!?.,;:|*&%$#@<>{}[]()=_/\\+~^\"'`-"
WIDTH = 13 + len(MARKS)
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_MARKS = np.frombuffer(MARKS, np.uint8)


def features_of(text: bytes | None) -> list[float]:
    raw = text or b""
    words = raw.split()
    n, n_words = max(len(raw), 1), max(len(words), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(int(counts[_LETTER].sum()), 1)
    distinct = len(set(words))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    lines = raw.count(b"\n") + 1
    marks = np.sqrt(counts[_MARKS] / n_words)
    other = counts.sum() - counts[_LETTER].sum() - counts[_DIGIT].sum() - counts[_SPACE].sum()
    return [
        math.log1p(len(raw)), math.log1p(len(words)), int(counts[_UPPER].sum()) / letters,
        int(counts[_DIGIT].sum()) / n, int(other) / n, int(counts[_SPACE].sum()) / n, letters / n,
        math.log(max(letters / n_words, 0.1)), distinct / n_words, math.log1p(n_words) * (1 - distinct / n_words),
        repeats / n_words, math.log1p(n_words / lines), float(len(words) < 5), *marks.tolist(),
    ]


def features(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features_of(t) for t in texts], dtype=float).reshape(-1, WIDTH)


def train(
    docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT_FOLD,
    max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED,
) -> LinearScorer:
    """Fit on at most ``max_positives`` trusted and ``max_unlabelled`` unlabelled documents.

    Labels of the held-out fold are never read. Without labels every score is
    the class prior.
    """
    sample, prior = training_sample(docs, labels, "quality", folds, fold, max_positives, max_unlabelled)
    positive, unlabelled = collect_features(sample, features, WIDTH)
    return fit_nnpu(positive, unlabelled, prior)


def quality(docs: DataFrame, model: LinearScorer, folds: int = FOLDS, fold: int = HELD_OUT_FOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null counts as an empty text."""
    scored = score_documents(docs.select("doc_id", "text"), features, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
