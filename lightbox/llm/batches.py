"""Texts of Arrow batches in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 4_000_000


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct ``row``: names of an operator's own columns cannot clash with it."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def pieces(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Consecutive rows of ``batches`` with their texts, about ``limit`` bytes at a time.

    ``text`` names a column, or a field of the struct column ``row`` as ``row.name``.
    A single longer text is a piece of its own, whole.
    """
    outer, _, inner = text.partition(".")
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(outer)
        if inner:
            values = pc.struct_field(values, inner)
        values = values.cast(pa.binary())
        total = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy())
        at = 0
        while at < len(total):
            done = total[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(at, upto - at), values.slice(at, upto - at).to_pylist()
            at = upto
