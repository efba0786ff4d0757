"""Positive-unlabelled learning of a linear scorer (non-negative risk, numpy)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lightbox.llm.batches import pieces
from lightbox.session import durable


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


@dataclass
class LinearScorer:
    """Sigmoid score of standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        return _sigmoid(((features - self.mean) / self.scale) @ self.weights + self.bias)


def risk(z_positive: np.ndarray, z_unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """(positive part, unbiased negative part) of the PU risk at margins ``z``.

    With the sigmoid loss l(z) = 1 / (1 + e^z). The negative part,
    E_U[l(-z)] - prior * E_P[l(-z)], estimates a quantity that cannot be
    negative; it becomes so only where the model overfits.
    """
    hit = prior * float(np.mean(_sigmoid(z_positive)))
    return prior - hit, float(np.mean(_sigmoid(z_unlabelled))) - hit


def fit_nnpu(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float,
    *, steps: int = 1500, rate: float = 0.02, ridge: float = 1e-3,
) -> LinearScorer:
    """Minimise prior * R_P+ + max(0, R_U- - prior * R_P-) by full-batch Adam.

    The unlabelled rows stand for all rows, positives among them. Where the
    negative part is negative, the maximum is flat and only the positive part
    pulls, so fitting stops short of a separation that the prior rules out.
    ``prior`` is kept within [0.001, 0.999]. With no positives (or no unlabelled
    rows) the scorer is the prior itself.
    """
    width = positive.shape[1]
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    start = float(np.log(prior / (1 - prior)))
    both = np.concatenate([positive, unlabelled])
    mean = both.mean(axis=0) if len(both) else np.zeros(width)
    scale = both.std(axis=0) if len(both) else np.ones(width)
    scale = np.where(scale > 1e-9, scale, 1.0)
    if not len(positive) or not len(unlabelled):
        return LinearScorer(mean, scale, np.zeros(width), start)
    p = np.hstack([(positive - mean) / scale, np.ones((len(positive), 1))])
    u = np.hstack([(unlabelled - mean) / scale, np.ones((len(unlabelled), 1))])
    w = np.zeros(width + 1)
    w[-1] = start
    first, second = np.zeros_like(w), np.zeros_like(w)
    decay = np.full_like(w, ridge)
    decay[-1] = 0.0
    for step in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        sp, su = _sigmoid(zp), _sigmoid(zu)
        toward = prior * (p.T @ (sp * (1 - sp))) / len(p)
        gradient = decay * w - toward
        if risk(zp, zu, prior)[1] > 0:
            gradient = gradient + (u.T @ (su * (1 - su))) / len(u) - toward
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return LinearScorer(mean, scale, w[:-1], float(w[-1]))


def label_of(labels: DataFrame, label: str, id: str = "doc_id") -> DataFrame:
    """(doc_id, y): one label per id, the largest if an id has several; nulls are no labels."""
    return (
        labels.where(F.col(label).isNotNull() & F.col(id).isNotNull())
        .groupBy(F.col(id).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    )


def held_out(id: Column, folds: int, fold: int) -> Column:
    """Whether crc32(id as text) mod ``folds`` is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int,
    max_positives: int, max_unlabelled: int, id: str = "doc_id", text: str = "text",
) -> tuple[DataFrame, float]:
    """((text, positive) rows, written once, and the class prior).

    At most ``max_positives`` trusted positives and ``max_unlabelled`` documents of
    the training folds, in the order of a seeded hash of the id. The prior is
    the share of positives among all labels of the training folds (0.5 without any).
    """
    known = label_of(labels, label, id).where(~held_out(F.col("doc_id"), folds, fold))
    counts = known.agg(F.sum("y").alias("ones"), F.count("*").alias("n")).first()
    prior = counts["ones"] / counts["n"] if counts["n"] else 0.5

    def least(ids: DataFrame, n: int, positive: bool) -> DataFrame:
        chosen = ids.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(n)
        return chosen.distinct().withColumn("positive", F.lit(positive))

    named = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    everyone = named.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    chosen = least(known.where("y = 1").select("doc_id"), max_positives, True).unionByName(
        least(everyone, max_unlabelled, False)
    )
    # At most max_positives + max_unlabelled ids of eight bytes.
    rows = named.join(F.broadcast(chosen), "doc_id")
    # Ids may repeat in ``docs``: one row of each is used, the one with the least text.
    single = rows.groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    return durable(single.select("text", "positive")), prior


def collect_features(sample: DataFrame, features: Callable[[list[bytes | None]], np.ndarray], width: int):
    """(positive rows, unlabelled rows) of ``width`` features; bounded by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            x = features(texts)
            yield pa.record_batch({
                "positive": batch.column(1),
                "x": pa.ListArray.from_arrays(np.arange(0, x.size + 1, width, dtype=np.int32), x.ravel()),
            })

    rows = sample.mapInArrow(run, "positive boolean, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, width)
    mark = rows["positive"].to_numpy(bool)
    # The collected order depends on scheduling; sums do not when rows are sorted.
    return _sorted(x[mark]), _sorted(x[~mark])


def _sorted(x: np.ndarray) -> np.ndarray:
    return x[np.lexsort(x.T)] if len(x) else x


def score_documents(
    docs: DataFrame, features: Callable[[list[bytes | None]], np.ndarray], scorer: LinearScorer, text: str = "text"
) -> DataFrame:
    """The columns of ``docs`` and the score of every row, in one pass without a shuffle.

    ``text`` is a column, or a field ``row.name`` of a struct column ``row``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text):
            scores = pa.array(scorer.scores(features(texts)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
