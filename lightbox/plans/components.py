"""Connected components of an edge table, fully distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightbox.session import durable

EDGE = "u long, v long"


def min_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, least id reachable) for the edges of one batch."""
    ids, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(ids))
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return ids, ids[label]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label = label[label]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one edge per id that connects exactly what the given edges connect."""
    ids, low = min_labels(u, v)
    keep = ids != low
    return ids[keep], low[keep]


def contract(edges: DataFrame) -> DataFrame:
    """Replace the edges of each partition by a forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = v = np.empty(0, np.int64)
        for batch in batches:
            u, v = forest(
                np.concatenate([u, batch.column(0).to_numpy()]),
                np.concatenate([v, batch.column(1).to_numpy()]),
            )
        yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, EDGE)


def _large_star(edges: DataFrame) -> DataFrame:
    """Point the larger neighbours of every node at its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where(F.col("v") > F.col("u")).join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Point the smaller neighbours of every node, and the node, at the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (
        edges.join(least, "u").where(F.col("v") != F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _is_star(edges: DataFrame) -> bool:
    """Every node points once, and at a node that points nowhere."""
    n = edges.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
    if n["n"] != n["d"]:
        return False
    return edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of an edge, component being its least id.

    Alternates large-star and small-star after contracting each partition, with
    the edges made durable each round. A hub's neighbours meet its single
    minimum in a join that adaptive execution may split, never in one group.
    """
    current = durable(contract(edges.where(F.col("u") != F.col("v"))))
    while not _is_star(current):
        current = durable(contract(_small_star(_large_star(current))))
    members = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
