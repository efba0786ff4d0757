"""Change feed: parsing and view maintenance.

Every function takes a batch or a stream where its plan allows it; the stateful
ones have a streaming form beside them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightbox.session import durable

# Event kinds and the field that must be there.
REQUIRED = {
    "MediaCreated": "item.id",
    "MediaUpdated": "id",
    "MediaDeleted": "id",
    "MediaBatchDeleted": "ids",
    "MediaTagsUpdated": "ids",
    "FolderCreated": "folder",
    "FolderDeleted": "id",
    "FolderRenamed": "id",
    "FoldersReordered": "ids",
    "MediaAddedToFolder": "media_ids",
    "MediaRemovedFromFolder": "media_ids",
    "UploadComplete": None,
    "TagLearningComplete": "tag_name",
    "FullRefresh": None,
    "ThumbnailFixStarted": None,
    "ThumbnailFixCompleted": "count",
}

# Kinds that ask for one refresh after a quiet time, in milliseconds.
REFRESH_KINDS = ("TagLearningComplete", "FullRefresh", "UploadComplete")
REFRESH_QUIET_MS = 500

ITEM = (
    "struct<id:string,filename:string,original_filename:string,media_type:string,"
    "original_date:string,size_bytes:bigint,is_favorite:boolean,"
    "tags:array<struct<name:string,is_auto:boolean,confidence:double>>>"
)
EVENT = (
    f"type string, data struct<id:string,ids:array<string>,item:{ITEM},folder:string,name:string,"
    "folder_id:string,media_ids:array<string>,tags:array<string>,tag_name:string,count:bigint>"
)


def parse_changes(raw: DataFrame, text: str = "value") -> DataFrame:
    """One row per event: ``type``, ``ids``, ``item`` and the other fields, and
    ``reason`` for text that is no known event. Filter on it to split rejects."""
    missing = F.coalesce(
        *[
            F.when((F.col("_e.type") == kind) & F.col(f"_e.data.{need}").isNull(), f"missing {need}")
            for kind, need in REQUIRED.items() if need
        ]
    )
    ids = F.coalesce(
        F.col("_e.data.ids"), F.col("_e.data.media_ids"),
        F.when(F.col("_e.data.id").isNotNull(), F.array("_e.data.id")),
        F.when(F.col("_e.data.item.id").isNotNull(), F.array("_e.data.item.id")),
    )
    rest = [c for c in raw.columns if c != text]
    return raw.withColumn("_e", F.from_json(text, EVENT)).select(
        *rest, F.col("_e.type").alias("type"), ids.alias("ids"), F.col("_e.data.item").alias("item"),
        F.col("_e.data.folder_id").alias("folder_id"), F.col("_e.data.tags").alias("tags"),
        F.col("_e.data.name").alias("name"), F.col("_e.data.tag_name").alias("tag_name"),
        F.col("_e.data.count").alias("count"),
        F.when(F.col("_e.type").isNull(), "unreadable")
        .when(~F.col("_e.type").isin(*REQUIRED), "unknown type")
        .otherwise(missing).alias("reason"),
    )


@dataclass(frozen=True)
class View:
    """Filters of one listing: every tag, favorites only, one type, one folder."""

    tags: Sequence[str] = field(default_factory=tuple)
    favorites: bool = False
    media_type: str | None = None
    folder: bool = False


VIEW_FIELDS = ("original_filename", "media_type", "original_date", "size_bytes", "is_favorite", "tags")


def item_events(events: DataFrame) -> DataFrame:
    """(seq, id, action, fields...) for the events that concern single items."""
    concerned = events.where(
        F.col("reason").isNull()
        & F.col("type").isin(
            "MediaCreated", "MediaUpdated", "MediaDeleted", "MediaBatchDeleted", "MediaTagsUpdated"
        )
    )
    action = (
        F.when(F.col("type") == "MediaCreated", "create")
        .when(F.col("type").isin("MediaDeleted", "MediaBatchDeleted"), "delete")
        .otherwise("update")
    )
    names = F.coalesce(F.col("tags"), F.transform("item.tags", lambda t: t["name"]))
    return concerned.select(
        "seq", F.explode("ids").alias("id"), action.alias("action"),
        *[F.col(f"item.{f}").alias(f) for f in VIEW_FIELDS if f != "tags"], names.alias("tags"),
    )


def _rejected(view: View, missing_fails: bool) -> Column:
    """Do the row's own fields break a filter? Absent fields count when told so."""
    out = F.lit(False)
    if view.favorites:
        out = out | F.coalesce(~F.col("is_favorite"), F.lit(missing_fails))
    if view.tags:
        wanted = F.array(*[F.lit(t) for t in view.tags])
        out = out | F.coalesce(F.size(F.array_except(wanted, "tags")) > 0, F.lit(missing_fails))
    return out


def apply_changes(current: DataFrame, events: DataFrame, view: View = View()) -> DataFrame:
    """The listing after all ``events`` (from :func:`item_events`), applied in ``seq`` order.

    ``current`` holds (id, fields...). An event removes the item, overlays the
    fields it carries on a shown item, or, when it is a create that passes the
    filters, shows it. What happened before the last removal of an item cannot
    matter, so the result needs only aggregates per item and no replay.
    """
    create_fails = _rejected(view, missing_fails=True)
    if view.media_type is not None:
        create_fails = create_fails | (F.coalesce("media_type", F.lit("")) != view.media_type)
    if view.folder:
        create_fails = F.lit(True)
    shows = (F.col("action") == "create") & ~create_fails
    if view.favorites:
        shows = shows | (
            (F.col("action") == "update") & F.coalesce("is_favorite", F.lit(False))
            & ~_rejected(view, missing_fails=False)
        )
    hides = (F.col("action") == "delete") | _rejected(view, missing_fails=False)
    # Read by four aggregates below; parsed and exploded once.
    marked = durable(events.withColumns({"_shows": shows & ~hides, "_hides": hides}))

    hidden = marked.where("_hides").groupBy("id").agg(F.max("seq").alias("_gone"))
    alive = marked.join(hidden, "id", "left").where(
        F.col("_gone").isNull() | (F.col("seq") > F.col("_gone"))
    )
    kept = current.join(hidden.select("id"), "id", "left_anti")
    # A kept item takes every later event; any other starts at the first that shows it.
    births = alive.where("_shows").groupBy("id").agg(F.min("seq").alias("_born"))
    starts = births.join(kept.select("id", F.lit(True).alias("_kept")), "id", "full").select(
        "id", F.when(F.col("_kept").isNull(), F.col("_born")).alias("_born")
    )
    live = alive.drop("_gone").join(starts, "id").where(
        F.col("_born").isNull() | (F.col("seq") >= F.col("_born"))
    )
    latest = live.groupBy("id").agg(
        *[
            F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"_{f}")
            for f in VIEW_FIELDS
        ]
    )
    fields = [f for f in VIEW_FIELDS if f in current.columns]
    return kept.select("id", *fields).join(latest, "id", "full").select(
        "id", *[F.coalesce(f"_{f}", f).alias(f) for f in fields]
    )


def refresh_requests(events: DataFrame) -> DataFrame:
    return events.where(F.col("reason").isNull() & F.col("type").isin(*REFRESH_KINDS))


def membership_changes(events: DataFrame) -> DataFrame:
    """(seq, ts, folder_id, media_id, delta) of additions and removals."""
    delta = F.when(F.col("type") == "MediaAddedToFolder", 1).otherwise(-1)
    return events.where(
        F.col("reason").isNull() & F.col("type").isin("MediaAddedToFolder", "MediaRemovedFromFolder")
    ).select("seq", "ts", "folder_id", F.explode("ids").alias("media_id"), delta.alias("delta"))


def memberships_after(base: DataFrame, events: DataFrame) -> DataFrame:
    """(folder_id, media_id) after all ``events`` (parsed, with ``seq``).

    The last addition or removal of a pair decides, whatever was said before
    it; a deleted item leaves all folders it was in by then. Aggregates per pair
    and per item, so the hottest folder is no single group.
    """
    last = membership_changes(events).groupBy("folder_id", "media_id").agg(
        F.max_by("delta", "seq").alias("_delta"), F.max("seq").alias("_seq")
    )
    gone = item_events(events).where("action = 'delete'").groupBy(F.col("id").alias("media_id")).agg(F.max("seq").alias("_gone"))
    held = base.select("folder_id", F.col("media_id").cast("string").alias("media_id"), F.lit(True).alias("_held")).distinct()
    pairs = held.join(last, ["folder_id", "media_id"], "full").join(gone, "media_id", "left")
    added = (F.col("_delta") == 1) & (F.col("_gone").isNull() | (F.col("_seq") > F.col("_gone")))
    stays = F.col("_delta").isNull() & F.col("_held") & F.col("_gone").isNull()
    return pairs.where(F.coalesce(added, F.lit(False)) | F.coalesce(stays, F.lit(False))).select("folder_id", "media_id")


def folder_counts_after(base: DataFrame, events: DataFrame) -> DataFrame:
    """(folder_id, item_count) of the folders that hold items after all events."""
    return memberships_after(base, events).groupBy("folder_id").agg(F.count("*").alias("item_count"))
