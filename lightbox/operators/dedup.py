"""Duplicate decisions on ingest and fingerprint reports.

Decisions are made per hash by an aggregate and travel back to rows by item id,
so a hash shared by a third of the batch never gathers its rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightbox.functions import scalars as S
from lightbox.session import durable


def dedup_ingest(new: DataFrame, existing: DataFrame, arrival: str = "uploaded_at") -> DataFrame:
    """Add ``status``: created, duplicate or rejected, and ``reason``.

    The first arrival of a hash unknown to the library is created, later ones
    are duplicates; items without a hash are never duplicates; file types
    outside the allowlist are rejected before anything else.
    """
    reason = S.rejection_reason(S.file_extension(F.col("original_filename")))
    rows = new.withColumn("reason", reason)
    hashed = rows.where(F.col("reason").isNull() & (F.col("phash") != S.NO_HASH))
    # Hashes may come from expensive processing, and two joins follow: computed once.
    first = durable(hashed.groupBy("phash").agg(F.min_by("id", F.struct(arrival, "id")).alias("id")))
    # A small batch is broadcast against the library's hashes; neither side moves whole.
    known = existing.select("phash").join(first.select("phash"), "phash", "left_semi").distinct()
    accepted = first.join(known, "phash", "left_anti").select("id", F.lit(True).alias("_first"))
    return rows.join(accepted, "id", "left").withColumn(
        "status",
        F.when(F.col("reason").isNotNull(), "rejected")
        .when(F.col("_first") | (F.col("phash") == S.NO_HASH), "created")
        .otherwise("duplicate"),
    ).drop("_first")


def ingest_report(decided: DataFrame, batch: str = "batch") -> DataFrame:
    """Done, skipped and failed counts per batch."""
    return decided.groupBy(batch).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "created").alias("done"),
        F.count_if(F.col("status") == "duplicate").alias("skipped"),
        F.count_if(F.col("status").isin("rejected", "failed")).alias("failed"),
    )


def ingest_errors(decided: DataFrame, batch: str = "batch") -> DataFrame:
    """One row per failed file; rows, not a list, as a batch may fail whole."""
    return decided.where(F.col("status").isin("rejected", "failed")).select(batch, "original_filename", "reason")


def composite_fingerprint(items: DataFrame, frames: DataFrame) -> DataFrame:
    """Frame hashes in frame order joined by ``|``; failed frames are skipped.

    ``frames`` holds (id, frame_no, hash). An item without any hash gets the
    sentinel for unknown.
    """
    joined = frames.where(F.col("hash").isNotNull()).groupBy("id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("frame_no", "hash"))), lambda s: s["hash"]),
            "|",
        ).alias("phash")
    )
    return items.select("id").join(joined, "id", "left").withColumn(
        "phash", F.coalesce("phash", F.lit(S.NO_HASH))
    )


def content_fingerprint(content: Column) -> Column:
    """Exact fingerprint of whole text or binary content."""
    return F.sha2(content.cast("binary"), 256)


def duplicate_report(media: DataFrame, arrival: str = "uploaded_at") -> DataFrame:
    """Hashes held by several items, how many, and the item that came first."""
    return (
        media.where(F.col("phash") != S.NO_HASH)
        .groupBy("phash")
        .agg(F.count("*").alias("copies"), F.min_by("id", F.struct(arrival, "id")).alias("kept_id"))
        .where(F.col("copies") > 1)
    )
