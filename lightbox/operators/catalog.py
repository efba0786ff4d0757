"""Catalog queries: filters, lookups, counts, order and pages.

Filters are semi- and anti-joins, so a bridge table never multiplies items, and
they run before anything is sorted. Tags are collected only for the rows that
are returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightbox.functions import scalars as S
from lightbox.plans.ordered import ranked_slice
from lightbox.session import durable

# Page size defaults and cap, and labels needed to train a tag.
DEFAULT_PAGE = 20
MAX_PAGE = 200
MIN_TRAINING_LABELS = 3


def derive_catalog(media: DataFrame) -> DataFrame:
    """Add ``ext``, ``media_type`` and ``original_date`` from stored metadata."""
    ext = S.file_extension(F.col("original_filename"))
    date = S.resolve_original_date(
        F.col("exif_json"), F.col("original_filename"), F.col("uploaded_at")
    )
    return media.select(
        "*", ext.alias("ext"), S.media_type(ext).alias("media_type"), date.alias("original_date")
    )


SUMMARY_COLUMNS = (
    "id", "original_filename", "media_type", "uploaded_at", "original_date", "size_bytes",
)


def export_summary(media: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The narrow listing record; metadata, dimensions and hash are never read."""
    return media.select(*SUMMARY_COLUMNS, *extra)


# --- filters -----------------------------------------------------------------


def filter_media_type(media: DataFrame, media_type: str | None) -> DataFrame:
    return media if media_type is None else media.where(F.col("media_type") == media_type)


def filter_favorite(media: DataFrame, favorites: DataFrame) -> DataFrame:
    return media.join(
        favorites.select(F.col("media_id").alias("id")), "id", "left_semi"
    )


def filter_tags_any(media: DataFrame, media_tags: DataFrame, names: Sequence[str]) -> DataFrame:
    """Items carrying at least one of ``names``; an empty list keeps everything."""
    if not names:
        return media
    hits = media_tags.where(F.col("tag").isin(*names)).select(F.col("media_id").alias("id"))
    return media.join(hits, "id", "left_semi")


def filter_tags_all(media: DataFrame, media_tags: DataFrame, names: Sequence[str]) -> DataFrame:
    """Items carrying every one of ``names``."""
    wanted = sorted(set(names))
    if not wanted:
        return media
    hits = (
        media_tags.where(F.col("tag").isin(*wanted))
        .select("media_id", "tag").distinct()
        .groupBy(F.col("media_id").alias("id")).agg(F.count("*").alias("n"))
        .where(F.col("n") == len(wanted))
    )
    return media.join(hits, "id", "left_semi")


def filter_folder(media: DataFrame, folder_media: DataFrame, folder_id) -> DataFrame:
    members = folder_media.where(F.col("folder_id") == folder_id)
    return media.join(members.select(F.col("media_id").alias("id")), "id", "left_semi")


def unhashed_media(media: DataFrame) -> DataFrame:
    return media.where(F.col("phash") == S.NO_HASH)


def suggest_tags(tags: DataFrame, text: str, chosen: DataFrame | Sequence[str] = ()) -> DataFrame:
    """Tag names containing ``text`` in any case, minus those already chosen."""
    if not text.strip():
        return tags.limit(0)
    hits = tags.where(F.lower("tag").contains(text.lower()))
    if isinstance(chosen, DataFrame):
        return hits.join(chosen.select("tag"), "tag", "left_anti")
    return hits.where(~F.col("tag").isin(*chosen)) if chosen else hits


# --- lookups -----------------------------------------------------------------


def with_favorites(media: DataFrame, favorites: DataFrame) -> DataFrame:
    """Add ``is_favorite``; the favorites table has one row per item."""
    marks = favorites.select(F.col("media_id").alias("id"), F.lit(True).alias("_fav"))
    return media.join(marks, "id", "left").withColumn(
        "is_favorite", F.col("_fav").isNotNull()
    ).drop("_fav")


def folder_items(media: DataFrame, folder_media: DataFrame, folder_id=None) -> DataFrame:
    """Members with their folder: of one folder, or of all."""
    bridge = folder_media.select("folder_id", F.col("media_id").alias("id"))
    if folder_id is not None:
        bridge = bridge.where(F.col("folder_id") == folder_id)
    return bridge.join(media, "id")


def tags_for_media(media_tags: DataFrame) -> DataFrame:
    """One row per item with its tags in name order.

    A group is one item's tags, so its size is bounded by the tag dictionary.
    """
    detail = F.struct(
        F.col("tag").alias("name"), F.col("is_auto"), F.col("confidence")
    )
    return media_tags.groupBy(F.col("media_id").alias("id")).agg(
        F.array_sort(F.collect_list(detail)).alias("tags")
    )


NO_TAGS = "array<struct<name:string,is_auto:boolean,confidence:double>>"


def with_tags(items: DataFrame, media_tags: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Add each item's tags. With ``ids`` only tag rows of those ids are collected."""
    rows = media_tags
    if ids is not None:
        rows = media_tags.join(ids.select(F.col("id").alias("media_id")), "media_id", "left_semi")
    return items.join(tags_for_media(rows), "id", "left").withColumn(
        "tags", F.coalesce("tags", F.array().cast(NO_TAGS))
    )


def with_page_details(rows: DataFrame, favorites: DataFrame, media_tags: DataFrame) -> DataFrame:
    """Favorite mark and tags for at most a page of rows.

    The page is made durable first: it is tiny, and each of the joins below
    would otherwise run the whole search again to find it.
    """
    rows = durable(rows)
    few = F.broadcast(rows.select("id"))
    marks = favorites.join(few.withColumnRenamed("id", "media_id"), "media_id", "left_semi")
    return with_tags(with_favorites(rows, marks), media_tags, few)


def tag_names(tags: Column) -> Column:
    """Tags as text, ``*`` marking automatic ones."""
    return F.array_join(
        F.transform(tags, lambda t: F.concat(t["name"], F.when(t["is_auto"], "*").otherwise(""))), ","
    )


def exclude_ids(items: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return items.join(ids.select(key), key, "left_anti")


def find_by_ids(
    media: DataFrame, ids: DataFrame, favorites: DataFrame, media_tags: DataFrame
) -> DataFrame:
    """Full records of the wanted ids; unknown ids give nothing."""
    found = media.join(ids.select("id"), "id", "left_semi")
    return with_tags(with_favorites(found, favorites), media_tags, ids)


def resolve_requested(requested: DataFrame, media: DataFrame) -> DataFrame:
    """Known ids at the position of their first request."""
    first = requested.groupBy(F.col("media_id").alias("id")).agg(F.min("pos").alias("pos"))
    return first.join(media, "id")


def check_references(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose parent does not exist."""
    known = parents.select(F.col(parent_key).alias(key))
    return rows.join(known, key, "left_anti")


def reject_orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> None:
    """Raise when any row lacks its parent, as an enforced foreign key would."""
    if not check_references(rows, parents, key, parent_key).isEmpty():
        raise ValueError(f"unknown {parent_key} in column {key}")


def tag_ids_by_name(names: DataFrame, tags: DataFrame) -> DataFrame:
    return names.select("tag").join(tags.select("tag", "tag_id"), "tag")


def tag_names_by_id(ids: DataFrame, tags: DataFrame) -> DataFrame:
    return ids.select("tag_id").join(tags.select("tag", "tag_id"), "tag_id")


# --- counts ------------------------------------------------------------------


def media_counts(media: DataFrame) -> DataFrame:
    """Totals over the catalog; zeros when it is empty."""
    return media.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("media_type") == "image").alias("images"),
        F.count_if(F.col("media_type") == "video").alias("videos"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
    )


def tag_counts(media_tags: DataFrame, is_auto: bool | None = None) -> DataFrame:
    """Items per tag in use: all, only manual, or only automatic."""
    rows = media_tags if is_auto is None else media_tags.where(F.col("is_auto") == is_auto)
    return rows.groupBy("tag").agg(F.count("*").alias("n"))


def count_auto_tags(media_tags: DataFrame, folder_media: DataFrame | None = None) -> DataFrame:
    """Automatic tag rows: in total, or per folder when memberships are given."""
    auto = media_tags.where("is_auto")
    if folder_media is None:
        return auto.agg(F.count("*").alias("n"))
    per_item = auto.groupBy("media_id").agg(F.count("*").alias("k"))
    return (
        folder_media.join(per_item, "media_id").groupBy("folder_id").agg(F.sum("k").alias("n"))
    )


def folder_counts(folders: DataFrame, folder_media: DataFrame) -> DataFrame:
    counts = folder_media.groupBy("folder_id").agg(F.count("*").alias("item_count"))
    return (
        folders.join(counts, "folder_id", "left")
        .withColumn("item_count", F.coalesce("item_count", F.lit(0)))
        .orderBy("sort_order", F.lower("name"), "folder_id")
    )


def exists_by_fingerprint(batch: DataFrame, existing: DataFrame, key: str = "phash") -> DataFrame:
    """The batch with ``known``: does the library hold this hash already?

    Both sides are reduced to distinct hashes first, so a hash shared by many
    copies travels once; the flag returns over the distinct hashes.
    """
    held = existing.select(key).distinct()
    known = batch.select(key).distinct().join(held, key, "left_semi").withColumn("_k", F.lit(True))
    return batch.join(known, key, "left").withColumn("known", F.col("_k").isNotNull()).drop("_k")


def folder_size(media: DataFrame, folder_media: DataFrame) -> DataFrame:
    return (
        folder_items(media.select("id", "size_bytes"), folder_media)
        .groupBy("folder_id")
        .agg(F.count("*").alias("item_count"), F.sum("size_bytes").alias("total_bytes"))
    )


def ids_with_tag(media_tags: DataFrame, manual_only: bool = False) -> DataFrame:
    """(tag, item) rows; kept as rows because one tag may cover most items."""
    rows = media_tags.where(~F.col("is_auto")) if manual_only else media_tags
    return rows.select("tag", "media_id").distinct()


def trainable_tags(media_tags: DataFrame, minimum: int = MIN_TRAINING_LABELS) -> DataFrame:
    return tag_counts(media_tags, is_auto=False).where(F.col("n") >= minimum)


# --- order and pages ---------------------------------------------------------


def sort_keys(sort_by: str = "date", ascending: bool = False) -> list[Column]:
    """Order by date or size, newest or largest first; id settles ties."""
    key = F.col("size_bytes" if sort_by == "size" else "original_date")
    return [key.asc(), F.col("id").asc()] if ascending else [key.desc(), F.col("id").desc()]


def sort_media(media: DataFrame, sort_by: str = "date", ascending: bool = False) -> DataFrame:
    return media.orderBy(*sort_keys(sort_by, ascending))


def page_bounds(page: int | None, limit: int | None) -> tuple[int, int]:
    """(offset, limit) of a one-based page."""
    limit = min(DEFAULT_PAGE if limit is None else limit, MAX_PAGE)
    return (max(page or 1, 1) - 1) * limit, limit


# Rows up to a page's end beyond which they are ranked block by block instead of gathered.
DEEP_ROWS = 20_000


def page(
    media: DataFrame, page: int | None = 1, limit: int | None = None,
    sort_by: str = "date", ascending: bool = False, deep_rows: int = DEEP_ROWS,
) -> DataFrame:
    """One page. Each task keeps its best rows, so nothing is sorted in full.

    A page whose end lies beyond ``deep_rows`` is found by block counts over keys alone
    (:func:`ranked_slice`), so no task gathers what lies before it; then its records are read.
    """
    offset, size = page_bounds(page, limit)
    return page_rows(media, offset, size, sort_by, ascending, deep_rows)


def page_rows(
    media: DataFrame, offset: int, size: int, sort_by: str = "date", ascending: bool = False, deep_rows: int = DEEP_ROWS,
) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` of the order, as :func:`page` finds them."""
    if offset + size <= deep_rows:
        return sort_media(media, sort_by, ascending).offset(offset).limit(size)
    key = "size_bytes" if sort_by == "size" else "original_date"
    hits = durable(ranked_slice(media.select("id", key), [], sort_keys(sort_by, ascending), offset, offset + size))
    # At most MAX_PAGE rows.
    return sort_media(media.join(F.broadcast(hits.select("id")), "id", "left_semi"), sort_by, ascending)


def page_after(
    media: DataFrame, last_key, last_id, limit: int | None = None,
    sort_by: str = "date", ascending: bool = False,
) -> DataFrame:
    """The page behind a known last row: any depth at the price of page one."""
    key = F.col("size_bytes" if sort_by == "size" else "original_date")
    tie = F.col("id")
    if ascending:
        behind = (key > F.lit(last_key)) | ((key == F.lit(last_key)) & (tie > F.lit(last_id)))
    else:
        behind = (key < F.lit(last_key)) | ((key == F.lit(last_key)) & (tie < F.lit(last_id)))
    return page(media.where(behind), 1, limit, sort_by, ascending)


def page_per_folder(
    media: DataFrame, folder_media: DataFrame, page: int | None = 1, limit: int | None = None,
    sort_by: str = "date", ascending: bool = False, deep_rows: int = DEEP_ROWS,
) -> DataFrame:
    """The same page of every folder.

    The upper rank bound is a window limit, applied before and after the
    shuffle: each task sends at most page x size rows of one folder. Ranks are
    taken on keys alone, the records join the surviving rows. Pages that end beyond ``deep_rows``
    are found by block counts, so a hot folder's earlier rows meet in no task.
    """
    offset, size = page_bounds(page, limit)
    keys = folder_items(media.select("id", "size_bytes", "original_date"), folder_media)
    order = sort_keys(sort_by, ascending)
    if offset + size > deep_rows:
        ranked = ranked_slice(keys.select("folder_id", "id", "size_bytes", "original_date"), ["folder_id"], order, offset, offset + size)
    else:
        window = Window.partitionBy("folder_id").orderBy(*order)
        ranked = (
            keys.withColumn("rank", F.row_number().over(window))
            .where(F.col("rank") <= offset + size)
            .where(F.col("rank") > offset)
        )
    return ranked.select("folder_id", "rank", "id").join(media, "id")


def random_sample_n(
    items: DataFrame, n: int, seed: int, exclude: DataFrame | None = None, key: str = "id"
) -> DataFrame:
    """``n`` rows in a seeded hash order; exclusions apply afterwards, so fewer may remain."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    drawn = items.orderBy(order, key).limit(n)
    return drawn if exclude is None else exclude_ids(drawn, exclude, key)


# --- the catalog query ---------------------------------------------------------


def query_media(
    media: DataFrame, favorites: DataFrame, media_tags: DataFrame,
    folder_media: DataFrame | None = None, *, media_type: str | None = None,
    favorite: bool = False, tags: Sequence[str] = (), folder_id=None,
    page_no: int | None = 1, limit: int | None = None,
    sort_by: str = "date", ascending: bool = False,
) -> DataFrame:
    """All filters, then one page, then favorites and tags of that page only."""
    rows = filter_media_type(media, media_type)
    if folder_id is not None:
        rows = filter_folder(rows, folder_media, folder_id)
    if favorite:
        rows = filter_favorite(rows, favorites)
    rows = filter_tags_any(rows, media_tags, tags)
    found = page(export_summary(rows), page_no, limit, sort_by, ascending)
    # At most MAX_PAGE rows: they come to the driver once, and their ids reach the scans as filters.
    rows = found.collect()
    shown = found.sparkSession.createDataFrame(rows, found.schema)
    ids = [r["id"] for r in rows]
    marks = favorites.where(F.col("media_id").isin(ids))
    return with_tags(with_favorites(shown, marks), media_tags.where(F.col("media_id").isin(ids)))
