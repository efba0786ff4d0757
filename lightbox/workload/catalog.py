"""Catalog queries over the library views."""

from __future__ import annotations

from pyspark.sql import functions as F

from lightbox.operators import catalog as C
from lightbox.operators import sets
from lightbox.operators import stored as P
from lightbox.session import shared_folder
from lightbox.sources import tables
from lightbox.workload.registry import query
from lightbox.workload.scalars import CATALOG_VIEWS, ts_text

WANTED = ["label_1", "fr"]


def cat(lib):
    return C.derive_catalog(lib.media)


def sql_query(name, sql):
    return query(name, sql, CATALOG_VIEWS)


def day(col="original_date"):
    return ts_text(F.col(col)).alias(col)


PAGE_TAGS = """array_to_string(list(tag || case when is_auto then '*' else '' end order by tag, is_auto, confidence), ',')"""


@sql_query(
    "c6_query_media",
    f"""with hits as (
      select c.* from catalog c where media_type = 'image'
        and id in (select media_id from favorites)
        and id in (select media_id from media_tags where tag in ('label_1','fr'))
      order by original_date desc, id desc limit 20),
    t as (select media_id, {PAGE_TAGS} as names from media_tags group by media_id)
    select h.id, original_filename, media_type, strftime(original_date, '%Y-%m-%d %H:%M:%S') as original_date,
      size_bytes, true as is_favorite, coalesce(t.names, '') as tag_names
    from hits h left join t on t.media_id = h.id""",
)
def _(lib):
    rows = C.query_media(
        cat(lib), lib.favorites, lib.media_tags,
        media_type="image", favorite=True, tags=WANTED,
    )
    return rows.select(
        "id", "original_filename", "media_type", day(), "size_bytes", "is_favorite",
        C.tag_names(F.col("tags")).alias("tag_names"),
    )


@sql_query(
    "c6_query_media_in_folder",
    f"""with hits as (
      select c.* from catalog c where id in (select media_id from folder_media where folder_id = 'src0')
      order by size_bytes asc, id asc limit 20 offset 20),
    t as (select media_id, {PAGE_TAGS} as names from media_tags group by media_id)
    select h.id, size_bytes, h.id in (select media_id from favorites) as is_favorite, coalesce(t.names, '') as tag_names
    from hits h left join t on t.media_id = h.id""",
)
def _(lib):
    rows = C.query_media(
        cat(lib), lib.favorites, lib.media_tags, lib.folder_media,
        folder_id="src0", page_no=2, sort_by="size", ascending=True,
    )
    return rows.select(
        "id", "size_bytes", "is_favorite", C.tag_names(F.col("tags")).alias("tag_names")
    )


@sql_query(
    "a7_export_summary",
    """select id, original_filename, media_type, strftime(uploaded_at, '%Y-%m-%d %H:%M:%S') as uploaded_at,
    strftime(original_date, '%Y-%m-%d %H:%M:%S') as original_date, size_bytes from catalog""",
)
def _(lib):
    rows = C.export_summary(cat(lib))
    return rows.withColumns({c: ts_text(F.col(c)) for c in ("uploaded_at", "original_date")})


@sql_query(
    "a8_conform_schema",
    """select tag, media_id, false as is_auto, cast(null as double) as confidence, cast(0 as bigint) as trained_at_count
    from media_tags""",
)
def _(lib):
    old = lib.media_tags.select("media_id", "tag")
    return tables.conform_schema(
        old,
        "tag string, media_id bigint, is_auto boolean, confidence double, trained_at_count bigint",
        {"is_auto": False, "trained_at_count": 0},
    )


@sql_query(
    "a5_save_models",
    """with fresh as (select 'label_' || cast(label as varchar) as tag, count(*) as n from embeddings where vec_id % 4 = 0 group by label
      union all select lang, count(*) from documents where doc_id % 3 = 0 group by lang),
    trained as (select f.tag, f.n from fresh f left join models m on m.tag = f.tag where f.n <> coalesce(m.trained_at_count, 0))
    select coalesce(m.tag, t.tag) as tag, round(case when t.tag is not null then 0.5 else m.bias end, 6) as bias,
      cast(case when t.tag is not null then t.n else m.trained_at_count end as bigint) as trained_at_count,
      cast(coalesce(m.version, 0) + case when t.tag is not null then 1 else 0 end as bigint) as version
    from models m full join trained t on t.tag = m.tag""",
)
def _(lib):
    counts = C.tag_counts(lib.media_tags, is_auto=False)
    known = tables.last_trained_count(counts, lib.models)
    trained = counts.join(known, "tag").where(F.col("n") != F.col("trained_at_count")).select(
        "tag", F.array(F.lit(1.0)).alias("weights"), F.lit(0.5).alias("bias"),
        F.lit(-2.0).alias("platt_a"), F.lit(0.0).alias("platt_b"),
        F.col("n").alias("trained_at_count"),
    )
    return tables.save_models(lib.models, trained).select(
        "tag", F.round("bias", 6).alias("bias"), "trained_at_count", "version"
    )


@sql_query("b16_is_favorite", "select id, id in (select media_id from favorites) as is_favorite from media")
def _(lib):
    return C.with_favorites(lib.media.select("id"), lib.favorites)


@sql_query("c1_filter_media_type", "select id, original_filename, size_bytes from catalog where media_type = 'video'")
def _(lib):
    return C.filter_media_type(cat(lib), "video").select("id", "original_filename", "size_bytes")


@sql_query("c2_filter_favorite", "select id, size_bytes from media where id in (select media_id from favorites)")
def _(lib):
    return C.filter_favorite(lib.media.select("id", "size_bytes"), lib.favorites)


@sql_query(
    "c3_filter_tags_any",
    "select id, size_bytes from media where id in (select media_id from media_tags where tag in ('label_1','fr'))",
)
def _(lib):
    return C.filter_tags_any(lib.media.select("id", "size_bytes"), lib.media_tags, WANTED)


@sql_query(
    "c4_filter_tags_all",
    """select id, size_bytes from media where id in (select media_id from media_tags where tag in ('label_1','fr')
    group by media_id having count(distinct tag) = 2)""",
)
def _(lib):
    return C.filter_tags_all(lib.media.select("id", "size_bytes"), lib.media_tags, WANTED)


@sql_query(
    "c5_filter_folder",
    "select id, size_bytes from media where id in (select media_id from folder_media where folder_id = 'src0')",
)
def _(lib):
    return C.filter_folder(lib.media.select("id", "size_bytes"), lib.folder_media, "src0")


@sql_query("c7_unhashed_media", "select id, original_filename from media where phash = 'no_hash'")
def _(lib):
    return C.unhashed_media(lib.media).select("id", "original_filename")


@sql_query(
    "c8_suggest_tags",
    """select distinct tag from media_tags where contains(lower(tag), 'lab')
    and tag not in (select tag from media_tags where is_auto and confidence >= 0.9)""",
)
def _(lib):
    chosen = lib.media_tags.where("is_auto and confidence >= 0.9").select("tag")
    return C.suggest_tags(lib.media_tags.select("tag").distinct(), "LAB", chosen)


@sql_query(
    "d1_with_favorites",
    "select m.id, m.size_bytes, f.media_id is not null as is_favorite from media m left join favorites f on f.media_id = m.id",
)
def _(lib):
    return C.with_favorites(lib.media.select("id", "size_bytes"), lib.favorites)


@sql_query(
    "d2_folder_items",
    "select folder_id, id, original_filename from folder_media f join media m on m.id = f.media_id",
)
def _(lib):
    return C.folder_items(lib.media.select("id", "original_filename"), lib.folder_media)


@sql_query(
    "d4_tags_for_media",
    f"select media_id as id, {PAGE_TAGS} as tag_names, count(*) as n from media_tags group by media_id",
)
def _(lib):
    return C.tags_for_media(lib.media_tags).select(
        "id", C.tag_names(F.col("tags")).alias("tag_names"), F.size("tags").cast("long").alias("n")
    )


@sql_query(
    "d5_exclude_ids",
    "select id, size_bytes from media where id not in (select media_id from media_tags)",
)
def _(lib):
    tagged = lib.media_tags.select(F.col("media_id").alias("id"))
    return C.exclude_ids(lib.media.select("id", "size_bytes"), tagged)


@sql_query(
    "d6_find_by_ids",
    f"""with t as (select media_id, {PAGE_TAGS} as names from media_tags group by media_id)
    select m.id, m.phash, m.width, m.height, m.exif_json, m.id in (select media_id from favorites) as is_favorite,
      coalesce(t.names, '') as tag_names
    from media m left join t on t.media_id = m.id where m.id in (select media_id from requested)""",
)
def _(lib):
    ids = lib.requested.select(F.col("media_id").alias("id")).distinct()
    rows = C.find_by_ids(lib.media, ids, lib.favorites, lib.media_tags)
    return rows.select(
        "id", "phash", "width", "height", "exif_json", "is_favorite",
        C.tag_names(F.col("tags")).alias("tag_names"),
    )


@sql_query(
    "d7_resolve_requested",
    """select r.id, r.pos, m.original_filename from
    (select media_id as id, min(pos) as pos from requested group by media_id) r join media m on m.id = r.id""",
)
def _(lib):
    return C.resolve_requested(lib.requested, lib.media.select("id", "original_filename"))


@sql_query(
    "d9_check_references",
    "select media_id, tag from media_tags where media_id not in (select id from media)",
)
def _(lib):
    return C.check_references(lib.media_tags, lib.media, "media_id", "id").select("media_id", "tag")


# Events that name an item which is not there.
@sql_query(
    "d9_check_references_events",
    "select event_id, event_type from events where event_id not in (select id from media)",
)
def _(lib):
    return C.check_references(lib.events, lib.media, "event_id", "id").select("event_id", "event_type")


TAG_IDS = "(select tag, row_number() over (order by tag) as tag_id from (select distinct tag from media_tags))"


def tag_dictionary(lib):
    from lightbox.operators.changes import add_tags

    empty = lib.spark.createDataFrame([], "tag string, tag_id long")
    return add_tags(empty, lib.media_tags.select("tag"))


@sql_query(
    "d10_tag_dictionary",
    f"""select m.media_id, d.tag_id, d.tag from media_tags m join {TAG_IDS} d on d.tag = m.tag""",
)
def _(lib):
    tags = tag_dictionary(lib)
    ids = C.tag_ids_by_name(lib.media_tags.select("tag").distinct(), tags)
    names = C.tag_names_by_id(ids, tags)
    return lib.media_tags.select("media_id", "tag").join(names, "tag")


@sql_query(
    "e1_media_counts",
    """select count(*) as total, count(*) filter (where media_type = 'image') as images,
    count(*) filter (where media_type = 'video') as videos, cast(coalesce(sum(size_bytes), 0) as bigint) as total_bytes from catalog""",
)
def _(lib):
    return C.media_counts(cat(lib))


@sql_query("e2_tag_counts", "select tag, count(*) as n from media_tags group by tag")
def _(lib):
    return C.tag_counts(lib.media_tags).orderBy("tag")


@sql_query(
    "e3_tag_counts_by_origin",
    """select tag, is_auto, count(*) as n from media_tags group by tag, is_auto""",
)
def _(lib):
    manual = C.tag_counts(lib.media_tags, is_auto=False).withColumn("is_auto", F.lit(False))
    auto = C.tag_counts(lib.media_tags, is_auto=True).withColumn("is_auto", F.lit(True))
    return manual.unionByName(auto)


@sql_query(
    "e4_count_auto_tags",
    """select folder_id, count(*) as n from folder_media f join media_tags t on t.media_id = f.media_id and t.is_auto group by folder_id
    union all select '' as folder_id, count(*) from media_tags where is_auto""",
)
def _(lib):
    per_folder = C.count_auto_tags(lib.media_tags, lib.folder_media)
    total = C.count_auto_tags(lib.media_tags).withColumn("folder_id", F.lit(""))
    return per_folder.unionByName(total)


@sql_query(
    "e5_folder_counts",
    """select f.folder_id, f.name, cast(f.sort_order as bigint) as sort_order, coalesce(c.n, 0) as item_count from folders f
    left join (select folder_id, count(*) as n from folder_media group by folder_id) c on c.folder_id = f.folder_id""",
)
def _(lib):
    return C.folder_counts(lib.folders, lib.folder_media).select(
        "folder_id", "name", F.col("sort_order").cast("long").alias("sort_order"), "item_count"
    )


@sql_query(
    "e6_exists_by_fingerprint",
    "select id, phash, phash in (select phash from existing_media) as known from incoming_media",
)
def _(lib):
    return C.exists_by_fingerprint(lib.incoming_media.select("id", "phash"), lib.existing_media)


@sql_query(
    "e7_folder_size",
    """select folder_id, count(*) as item_count, cast(sum(size_bytes) as bigint) as total_bytes
    from folder_media f join media m on m.id = f.media_id group by folder_id""",
)
def _(lib):
    return C.folder_size(lib.media, lib.folder_media)


@sql_query(
    "e8_ids_with_tag",
    """select tag, media_id, bool_or(not is_auto) as manual from media_tags group by tag, media_id""",
)
def _(lib):
    manual = C.ids_with_tag(lib.media_tags, manual_only=True).withColumn("_m", F.lit(True))
    return C.ids_with_tag(lib.media_tags).join(manual, ["tag", "media_id"], "left").select(
        "tag", "media_id", F.col("_m").isNotNull().alias("manual")
    )


@sql_query(
    "e10_trainable_tags",
    "select tag, count(*) as n from media_tags where not is_auto group by tag having count(*) >= 3",
)
def _(lib):
    return C.trainable_tags(lib.media_tags)


@sql_query(
    "f1_sort_media",
    """select id, row_number() over (order by original_date desc, id desc) as by_date,
    row_number() over (order by size_bytes asc, id asc) as by_size from catalog""",
)
def _(lib):
    from lightbox.plans.ordered import positions

    rows = cat(lib).select("id", "original_date", "size_bytes")
    by_date = positions(rows.select("id", "original_date"), [], C.sort_keys("date"), "by_date")
    by_size = positions(rows.select("id", "size_bytes"), [], C.sort_keys("size", True), "by_size")
    return by_date.select("id", "by_date").join(by_size.select("id", "by_size"), "id")


@sql_query(
    "f2_page",
    """select id, strftime(original_date, '%Y-%m-%d %H:%M:%S') as original_date from catalog
    order by catalog.original_date desc, id desc limit 20 offset 20""",
)
def _(lib):
    return C.page(cat(lib).select("id", "original_date"), 2).select("id", day())


@sql_query(
    "f3_page_per_folder",
    """select folder_id, rank, id, size_bytes from (
      select folder_id, id, size_bytes, row_number() over (partition by folder_id order by original_date desc, id desc) as rank
      from folder_media f join catalog c on c.id = f.media_id) where rank > 20 and rank <= 40""",
)
def _(lib):
    rows = C.page_per_folder(
        cat(lib).select("id", "size_bytes", "original_date"), lib.folder_media, page=2
    )
    return rows.select("folder_id", F.col("rank").cast("long").alias("rank"), "id", "size_bytes")


# The same by block counts, the way of pages too deep to gather.
@sql_query(
    "f2_page_deep",
    """select id, strftime(original_date, '%Y-%m-%d %H:%M:%S') as original_date from catalog
    order by catalog.original_date desc, id desc limit 50 offset 300""",
)
def _(lib):
    return C.page(cat(lib).select("id", "original_date"), 7, 50, deep_rows=0).select("id", day())


@sql_query(
    "f3_page_per_folder_deep",
    """select folder_id, rank, id, size_bytes from (
      select folder_id, id, size_bytes, row_number() over (partition by folder_id order by original_date desc, id desc) as rank
      from folder_media f join catalog c on c.id = f.media_id) where rank > 40 and rank <= 60""",
)
def _(lib):
    rows = C.page_per_folder(
        cat(lib).select("id", "size_bytes", "original_date"), lib.folder_media, page=3, deep_rows=0
    )
    return rows.select("folder_id", "rank", "id", "size_bytes")


@sql_query(
    "f5_random_sample_n",
    """with drawn as (select vec_id, label from embeddings order by md5('42:' || cast(vec_id as varchar)), vec_id limit 30)
    select vec_id, label from drawn where vec_id not in (select media_id from media_tags where is_auto)""",
)
def _(lib):
    taken = lib.media_tags.where("is_auto").select(F.col("media_id").alias("vec_id"))
    return C.random_sample_n(lib.embeddings.select("vec_id", "label"), 30, 42, taken, "vec_id")


@sql_query(
    "g1_insert_ignore",
    """select media_id from favorites union select media_id from fav_changes where favorite""",
)
def _(lib):
    new = lib.fav_changes.where("favorite").select("media_id")
    return sets.insert_ignore(lib.favorites, new, ["media_id"])


@sql_query(
    "g2_upsert",
    """select tag, media_id, confidence from predictions
    union all select tag, media_id, confidence from media_tags m
    where not exists (select 1 from predictions p where p.tag = m.tag and p.media_id = m.media_id)""",
)
def _(lib):
    base = lib.media_tags.select("tag", "media_id", "confidence")
    return sets.upsert(base, lib.predictions, ["tag", "media_id"])


@sql_query(
    "g3_refresh_merge",
    """with shown as (select id, size_bytes, phash from existing_media),
    fresh as (select id, size_bytes + 1 as size_bytes, phash from media where size_bytes >= 500)
    select true as filtered, f.* from fresh f
    union all
    select false, coalesce(f.id, s.id), case when f.id is not null then f.size_bytes else s.size_bytes end,
      coalesce(f.phash, s.phash) from shown s full join fresh f on f.id = s.id""",
)
def _(lib):
    shown = lib.existing_media.select("id", "size_bytes", "phash")
    fresh = lib.media.where("size_bytes >= 500").select(
        "id", (F.col("size_bytes") + 1).alias("size_bytes"), "phash"
    )
    both = [
        sets.refresh_merge(shown, fresh, "id", filtered).withColumn("filtered", F.lit(filtered))
        for filtered in (True, False)
    ]
    return both[0].unionByName(both[1])


# --- the stored layout: derived once, clustered by capture time, pages by file bounds -------------


def stored(lib, file_rows=400):
    """Half of the items as one clustered run, the rest appended in two, so ranges of files overlap."""
    root = shared_folder(lib.spark, "catalog")
    P.write_catalog(lib.media.where("id % 2 = 0"), root, file_rows)
    P.append_catalog(lib.media.where("id % 4 = 1"), root, file_rows)
    P.append_catalog(lib.media.where("id % 4 = 3"), root, file_rows)
    return root


@sql_query(
    "f2_stored_page",
    """select id, original_filename, media_type, strftime(original_date, '%Y-%m-%d %H:%M:%S') as original_date, size_bytes
    from catalog order by catalog.original_date desc, id desc limit 40 offset 240""",
)
def _(lib):
    root = stored(lib)
    P.compact_catalog(lib.spark, root, 400)
    return P.stored_page(lib.spark, root, 7, 40).select("id", "original_filename", "media_type", day(), "size_bytes")


@sql_query(
    "f2_stored_page_of_runs",
    """select id, media_type, strftime(original_date, '%Y-%m-%d %H:%M:%S') as original_date
    from catalog where media_type = 'video' order by catalog.original_date, id limit 25 offset 25""",
)
def _(lib):
    return P.stored_page(lib.spark, stored(lib), 2, 25, "video", ascending=True).select("id", "media_type", day())


@sql_query(
    "f4_stored_page_after",
    """select id, strftime(original_date, '%Y-%m-%d %H:%M:%S') as original_date from catalog
    where original_date < timestamp '1996-01-01 12:30:00' and media_type = 'image'
    order by catalog.original_date desc, id desc limit 30""",
)
def _(lib):
    last = F.to_timestamp_ntz(F.lit("1996-01-01 12:30:00"))
    at = lib.spark.range(1).select(last.alias("at")).first()["at"]
    return P.stored_page_after(lib.spark, stored(lib), at, -1, 30, "image").select("id", day())


@sql_query(
    "e1_stored_counts",
    """select count(*) as total, count(*) filter (where media_type = 'image') as images,
    count(*) filter (where media_type = 'video') as videos, cast(coalesce(sum(size_bytes), 0) as bigint) as total_bytes from catalog""",
)
def _(lib):
    return P.stored_counts(lib.spark, stored(lib))


@sql_query(
    "c6_query_stored",
    f"""with hits as (
      select c.* from catalog c where media_type = 'image'
        and id in (select media_id from favorites)
        and id in (select media_id from media_tags where tag in ('label_1','fr'))
      order by original_date desc, id desc limit 20),
    t as (select media_id, {PAGE_TAGS} as names from media_tags group by media_id)
    select h.id, original_filename, strftime(original_date, '%Y-%m-%d %H:%M:%S') as original_date, coalesce(t.names, '') as tag_names
    from hits h left join t on t.media_id = h.id""",
)
def _(lib):
    rows = C.query_media(
        P.read_catalog(lib.spark, stored(lib)), lib.favorites, lib.media_tags,
        media_type="image", favorite=True, tags=WANTED,
    )
    return rows.select("id", "original_filename", day(), C.tag_names(F.col("tags")).alias("tag_names"))
