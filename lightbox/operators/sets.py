"""Keyed set operations that produce the next version of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the least by ``order``: an aggregate, so copies of a hot
    key are combined before the shuffle instead of meeting in one task."""
    return _pick(rows, key, F.min_by, order)


def last_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the greatest by ``order``."""
    return _pick(rows, key, F.max_by, order)


def _pick(rows: DataFrame, key: Sequence[str], choose, order: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    if not rest:
        return rows.distinct()
    best: Column = choose(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*key).agg(best.alias("_best")).select(
        *key, *[F.col("_best")[c].alias(c) for c in rest]
    ).select(*rows.columns)


def one_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the last by ``order``, or by all other columns where no order is given."""
    return last_per_key(rows, key, list(order) or [c for c in rows.columns if c not in key])


def additions(base: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key ``base`` lacks, one per key."""
    return new.dropDuplicates(list(key)).join(base.select(*key), list(key), "left_anti")


def insert_ignore(base: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return base.unionByName(additions(base, new, key), allowMissingColumns=True)


def upsert(base: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """``base`` with the rows of ``new`` replacing or joining it; of a key given twice the last by ``order``."""
    new = one_per_key(new, key, order)
    kept = base.join(new.select(*key), list(key), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def delete_keys(base: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    return base.join(gone.select(*key), list(key), "left_anti")


def refresh_merge(
    current: DataFrame, fresh: DataFrame, key: str, filtered: bool
) -> DataFrame:
    """Overlay fresh fields on the rows shown.

    New rows join; rows missing from ``fresh`` leave only when a filter is
    active, because then missing means no longer matching.
    """
    fields = [c for c in current.columns if c != key]
    c = current.select(key, F.lit(True).alias("_shown"), *[F.col(f).alias(f"_c_{f}") for f in fields])
    f = fresh.select(key, F.lit(True).alias("_fresh"), *[F.col(x).alias(f"_f_{x}") for x in fields])
    merged = c.join(f, key, "right" if filtered else "full")
    return merged.select(
        key,
        *[F.when(F.col("_fresh"), F.col(f"_f_{x}")).otherwise(F.col(f"_c_{x}")).alias(x) for x in fields],
    )
