"""Size-bounded export planning.

A plan is an ordered list of items, keyed by ``plan``. Names and parts depend on
the order inside a plan; both are computed with the ordered plans that split a
long list over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightbox.functions.scalars import safe_archive_name, sanitize_filename
from lightbox.operators import catalog as C
from lightbox.plans.ordered import FOLD_ROWS, greedy_segments, positions

# Bytes per archive part and lifetime of a plan in seconds.
MAX_PART_BYTES = 2 * 1024 * 1024 * 1024
PLAN_SECONDS = 3600


def unique_entry_names(items: DataFrame) -> DataFrame:
    """Add ``entry_name``: the cleaned name; its nth repeat in a plan carries ``_n``.

    ``items`` holds (plan, pos, id, original_filename, ...). Repeats are counted
    by the cleaned name, so a made-up name may equal a later original one.
    """
    named = items.withColumn("_base", sanitize_filename(F.col("original_filename")))
    nth = positions(named, ["plan", "_base"], [F.col("pos")], "_nth")
    stem = F.regexp_replace("_base", r"(?s)\.[^.]*$", "")
    ending = F.substring("_base", F.length(stem) + 1, F.length("_base"))
    repeat = (F.col("_nth") - 1).cast("string")
    return nth.withColumn(
        "entry_name",
        F.when(F.col("_nth") == 1, F.col("_base")).otherwise(
            F.concat(stem, F.lit("_"), repeat, ending)
        ),
    ).drop("_base", "_nth")


def pack_parts(
    items: DataFrame, cap: int = MAX_PART_BYTES, fold_rows: int = FOLD_ROWS
) -> DataFrame:
    """Add ``part`` (1-based): items in order, a new part when the next would pass ``cap``."""
    packed = greedy_segments(
        items, ["plan"], ["pos"], cap, size="size_bytes", fold_rows=fold_rows
    )
    return packed.withColumnRenamed("segment", "part").drop("rank")


def archive_name(base: Column, part: Column, parts: Column, stamp: str) -> Column:
    numbered = F.concat(base, F.lit("_part"), part, F.lit(f"_{stamp}.zip"))
    return F.when(parts == 1, F.concat(base, F.lit(f"_{stamp}.zip"))).otherwise(numbered)


def export_plan(
    items: DataFrame, names: DataFrame, stamp: str, cap: int = MAX_PART_BYTES,
    fold_rows: int = FOLD_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(parts, members): the archives of every plan and the items inside them.

    ``names`` holds (plan, base_name). Members stay rows (plan, part, pos, id):
    a part is bounded in bytes, not in items.
    """
    members = pack_parts(
        items.select("plan", "pos", "id", "size_bytes"), cap, fold_rows
    )
    parts = members.groupBy("plan", "part").agg(
        F.sum("size_bytes").alias("size_estimate"), F.count("*").alias("items")
    )
    totals = parts.groupBy("plan").agg(F.max("part").alias("_parts"))
    named = parts.join(totals, "plan").join(names, "plan").select(
        "plan", "part", F.concat_ws("-", "plan", "part").alias("part_id"),
        archive_name(F.col("base_name"), F.col("part"), F.col("_parts"), stamp).alias("filename"),
        "size_estimate", "items",
    )
    return named, members.select("plan", "part", "pos", "id")


def folder_export_plans(
    folders: DataFrame, folder_media: DataFrame, media: DataFrame, stamp: str,
    cap: int = MAX_PART_BYTES, fold_rows: int = FOLD_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Plans of all folders at once, items by id; see :func:`empty_folders` for the rest."""
    items = C.folder_items(media.select("id", "size_bytes"), folder_media).select(
        F.col("folder_id").alias("plan"), F.col("id").alias("pos"), "id", "size_bytes"
    )
    names = folders.select(
        F.col("folder_id").alias("plan"), safe_archive_name(F.col("name")).alias("base_name")
    )
    return export_plan(items, names, stamp, cap, fold_rows)


def empty_folders(folders: DataFrame, folder_media: DataFrame, media: DataFrame) -> DataFrame:
    """Folders that cannot be exported because no item is left in them."""
    used = folder_media.join(media.select(F.col("id").alias("media_id")), "media_id", "left_semi")
    return folders.join(used.select("folder_id"), "folder_id", "left_anti")


def batch_export_plan(
    requested: DataFrame, media: DataFrame, stamp: str, prefix: str = "export",
    cap: int = MAX_PART_BYTES, fold_rows: int = FOLD_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The plan of one requested id list, named after the number of items found."""
    items = C.resolve_requested(requested, media.select("id", "size_bytes")).select(
        F.lit("batch").alias("plan"), "pos", "id", "size_bytes"
    )
    names = items.groupBy("plan").agg(
        F.concat(F.lit(f"{prefix}_"), F.count("*").cast("string")).alias("base_name")
    )
    return export_plan(items, names, stamp, cap, fold_rows)


def expire_plans(plans: DataFrame, now: Column) -> DataFrame:
    """Plans still valid at ``now``; ``expires_at`` is set from the creation time."""
    return plans.where(F.col("expires_at") > now)


def with_expiry(plans: DataFrame, created: str = "created_at", seconds: int = PLAN_SECONDS) -> DataFrame:
    return plans.withColumn("expires_at", F.col(created) + F.make_dt_interval(secs=F.lit(seconds)))
