"""Table changes: base tables and a change set give the next tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightbox.functions.scalars import NO_HASH, strip
from lightbox.operators import sets
from lightbox.plans.ordered import positions


def set_favorites(favorites: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply on/off changes in ``seq`` order; only the last per item counts.

    Where favorites have a ``created_at``, a new one takes the time ``ts`` of its
    change, or the current time if changes carry none.
    """
    timed = "created_at" in favorites.columns
    at = F.col("ts") if "ts" in changes.columns else F.current_timestamp()
    wanted = changes.select("media_id", "seq", "favorite", *([at.alias("created_at")] if timed else []))
    last = sets.last_per_key(wanted, ["media_id"], ["seq"])
    kept = sets.delete_keys(favorites, last.where(~F.col("favorite")), ["media_id"])
    return sets.insert_ignore(kept, last.where("favorite").drop("seq", "favorite"), ["media_id"])


def add_tags(tags: DataFrame, names: DataFrame) -> DataFrame:
    """The tag dictionary with new names numbered on, in name order."""
    trimmed = names.select(strip(F.col("tag")).alias("tag")).where(F.col("tag") != "")
    new = trimmed.distinct().join(tags.select("tag"), "tag", "left_anti")
    numbered = positions(new, [], [F.col("tag")], "_n")
    top = tags.agg(F.coalesce(F.max("tag_id"), F.lit(0))).scalar()
    added = numbered.select("tag", (top + F.col("_n")).cast("long").alias("tag_id"))
    return tags.select("tag", F.col("tag_id").cast("long").alias("tag_id")).unionByName(added)


def replace_tags(
    media_tags: DataFrame, items: DataFrame, names: Sequence[str] | DataFrame
) -> DataFrame:
    """Drop every tag of ``items``, automatic ones too, and set ``names`` as manual.

    With a list every item gets the same names; with a frame of (media_id, tag)
    each item gets its own.
    """
    kept = sets.delete_keys(media_tags, items, ["media_id"])
    if isinstance(names, DataFrame):
        wanted = items.select("media_id").distinct().join(names, "media_id")
    else:
        listed = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
        wanted = items.select("media_id").distinct().withColumn("tag", F.explode(listed))
    wanted = wanted.select("media_id", strip(F.col("tag")).alias("tag")).where(F.col("tag") != "").distinct()
    return kept.unionByName(
        wanted.withColumns({"is_auto": F.lit(False), "confidence": F.lit(None).cast("double")})
    )


def merge_auto_tags(
    media_tags: DataFrame, predictions: DataFrame, processed: DataFrame,
    scope: DataFrame | None = None,
) -> DataFrame:
    """Replace the automatic rows of the processed tags inside ``scope``.

    Manual rows always stay and win over a prediction for the same item; an
    automatic row outside the scope that is predicted again takes the new
    confidence. Of an item predicted twice for a tag the higher confidence counts.
    """
    predictions = sets.one_per_key(predictions.select("tag", "media_id", "confidence"), ["tag", "media_id"])
    auto = media_tags.where("is_auto")
    manual = media_tags.where(~F.col("is_auto"))
    touched = auto.join(processed.select("tag"), "tag", "left_semi")
    if scope is not None:
        touched = touched.join(scope.select("media_id"), "media_id", "left_semi")
    key = ["tag", "media_id"]
    kept = sets.delete_keys(sets.delete_keys(auto, touched, key), predictions, key)
    fresh = sets.delete_keys(predictions, manual, key).select(
        "media_id", "tag", F.lit(True).alias("is_auto"), "confidence"
    )
    return manual.unionByName(kept).unionByName(fresh)


def add_to_folder(folder_media: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memberships, number added per folder); existing members are ignored."""
    key = ["folder_id", "media_id"]
    added = sets.additions(folder_media, new, key)
    counts = added.groupBy("folder_id").agg(F.count("*").alias("added"))
    return folder_media.unionByName(added, allowMissingColumns=True), counts


def remove_from_folder(folder_media: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memberships, number removed per folder)."""
    key = ["folder_id", "media_id"]
    removed = folder_media.join(gone.select(*key), key, "left_semi")
    counts = removed.groupBy("folder_id").agg(F.count("*").alias("removed"))
    return sets.delete_keys(folder_media, gone, key), counts


def delete_media(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Remove items from every table that mentions them.

    ``tables`` maps a table name to its frame; the item column is ``id`` in
    media and vectors and ``media_id`` elsewhere.
    """
    out = {}
    for name, df in tables.items():
        key = "id" if "id" in df.columns else "media_id"
        out[name] = sets.delete_keys(df, gone.select(F.col("media_id").alias(key)), [key])
    return out


def deleted_count(media: DataFrame, gone: DataFrame) -> DataFrame:
    """How many of the ids existed."""
    ids = gone.select(F.col("media_id").alias("id"))
    return media.join(ids, "id", "left_semi").agg(F.count("*").alias("deleted"))


def delete_folder(
    folders: DataFrame, folder_media: DataFrame, gone: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(folders, memberships) without the folders; their items stay."""
    return (
        sets.delete_keys(folders, gone, ["folder_id"]),
        sets.delete_keys(folder_media, gone, ["folder_id"]),
    )


def refused_names(names: DataFrame) -> DataFrame:
    """(folder_id, name) that creating and renaming refuse: null and blank names."""
    return names.select("folder_id", "name").where(F.coalesce(strip(F.col("name")), F.lit("")) == "")


def create_folders(folders: DataFrame, new: DataFrame) -> DataFrame:
    """Append folders after the last one, in ``pos`` order; see :func:`refused_names` for blank ones.

    Known folders stay as they are; of a folder given twice the later place counts.
    """
    new = sets.one_per_key(new.select("folder_id", "name", "pos"), ["folder_id"], ["pos", "name"])
    new = new.join(folders.select("folder_id"), "folder_id", "left_anti")
    named = new.select("folder_id", strip(F.col("name")).alias("name"), "pos").where(F.col("name") != "")
    numbered = positions(named, [], [F.col("pos"), F.col("folder_id")], "_n")
    top = folders.agg(F.coalesce(F.max("sort_order"), F.lit(-1))).scalar()
    added = numbered.select(
        "folder_id", "name", (top + F.col("_n")).cast("long").alias("sort_order")
    )
    base = folders.withColumn("sort_order", F.col("sort_order").cast("long"))
    return base.unionByName(added, allowMissingColumns=True)


def _overwrite(
    base: DataFrame, changes: DataFrame, key: str, column: str, order: Sequence[str] = ()
) -> DataFrame:
    """Of a key changed twice the last by ``order`` counts, or the greatest value."""
    last = sets.one_per_key(changes.select(key, column, *order), [key], order)
    new = last.select(key, F.col(column).alias("_new"))
    return base.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def rename_folders(folders: DataFrame, names: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """New names for known folders; see :func:`refused_names` for blank ones."""
    named = names.select("folder_id", strip(F.col("name")).alias("name"), *order).where(F.col("name") != "")
    return _overwrite(folders, named, "folder_id", "name", order)


def reorder_folders(folders: DataFrame, order: DataFrame) -> DataFrame:
    """``sort_order`` becomes the place in the given list."""
    placed = order.select("folder_id", F.col("pos").cast("long").alias("sort_order"))
    base = folders.withColumn("sort_order", F.col("sort_order").cast("long"))
    return _overwrite(base, placed, "folder_id", "sort_order")


def update_media(
    media: DataFrame, vectors: DataFrame, changed: DataFrame, changed_vectors: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Overwrite known items and replace, or drop, their vectors."""
    known = sets.one_per_key(changed, ["id"]).join(media.select("id"), "id", "left_semi")
    new_vectors = sets.one_per_key(changed_vectors, ["id"]).where(F.col("embedding").isNotNull()).join(
        known.select("id"), "id", "left_semi"
    )
    return (
        sets.upsert(media, known, ["id"]),
        sets.delete_keys(vectors, known, ["id"]).unionByName(new_vectors),
    )


def repair_media(
    media: DataFrame, reprocessed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(catalog, repaired rows) after hashing the unhashed items again.

    ``reprocessed`` holds (id, phash, width, height, exif_json, original_date)
    of the files that could be read. The capture time changes only when the new
    metadata names one. :func:`repair_vectors` takes the vectors of the repaired rows.
    """
    columns = ["id", "phash", "width", "height", "exif_json", "original_date"]
    fresh = sets.one_per_key(reprocessed.select(*columns), ["id"]).select(
        "id", F.lit(True).alias("_ok"),
        *[F.col(c).alias(f"_{c}") for c in ("phash", "width", "height", "exif_json", "original_date")],
    )
    joined = media.join(fresh, "id", "left").withColumn(
        "_fix", (F.col("phash") == NO_HASH) & F.coalesce("_ok", F.lit(False))
    )
    fixed = {
        c: F.when(F.col("_fix"), F.col(f"_{c}")).otherwise(F.col(c))
        for c in ("phash", "width", "height", "exif_json")
    }
    fixed["original_date"] = F.when(
        F.col("_fix"), F.coalesce("_original_date", "original_date")
    ).otherwise(F.col("original_date"))
    out = joined.withColumns(fixed)
    return out.select(*media.columns), out.where("_fix").select(*media.columns)


def repair_vectors(vectors: DataFrame, repaired: DataFrame, reprocessed: DataFrame) -> DataFrame:
    """Vectors of the repaired items replaced by those found when they were read again.

    ``reprocessed`` holds (id, embedding); a repaired item without a new vector keeps its old one.
    """
    found = sets.one_per_key(reprocessed.select("id", "embedding").where(F.col("embedding").isNotNull()), ["id"])
    fresh = found.join(repaired.select("id"), "id", "left_semi")
    return sets.delete_keys(vectors, fresh, ["id"]).unionByName(fresh, allowMissingColumns=True)
