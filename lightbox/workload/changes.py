"""Ingest decisions and table changes over the library views."""

from __future__ import annotations

from pyspark.sql import functions as F

from lightbox.functions import scalars as S
from lightbox.operators import catalog as C
from lightbox.operators import changes as L
from lightbox.operators import dedup as K
from lightbox.session import durable, shared_folder
from lightbox.streaming import jobs
from lightbox.workload.registry import query
from lightbox.workload.scalars import CATALOG_VIEWS, ts_text

DECISION_VIEWS = {
    **CATALOG_VIEWS,
    "incoming_typed": "select t.* from typed t join incoming_media i on i.id = t.id",
    "ranked": """
select id, phash, original_filename, uploaded_at,
  case when not (ext in ('jpg','jpeg','png','gif','webp','bmp','tiff','tif','heic','heif','avif','mp4','mov','avi','mkv','webm'))
    then 'File type not allowed: .' || ext end as reason,
  row_number() over (partition by phash, ext in ('jpg','jpeg','png','gif','webp','bmp','tiff','tif','heic','heif','avif','mp4','mov','avi','mkv','webm')
    order by uploaded_at, id) as nth
from incoming_typed""",
    "decided": """
select id, original_filename, uploaded_at, reason,
  case when reason is not null then 'rejected' when phash = 'no_hash' then 'created'
    when nth > 1 or phash in (select phash from existing_media) then 'duplicate' else 'created' end as status
from ranked""",
}


def decided_batch(lib):
    incoming = lib.incoming_media.select("id", "phash", "original_filename", "uploaded_at")
    return K.dedup_ingest(incoming, lib.existing_media)


@query("k1_dedup_ingest", "select id, status, reason from decided", DECISION_VIEWS)
def _(lib):
    return decided_batch(lib).select("id", "status", "reason")


# The same in three batches by arrival, each looking up its own hashes in the log that the stream keeps.
@query("n5_ingest_in_batches", "select id, status, reason from decided", DECISION_VIEWS)
def _(lib):
    incoming = durable(lib.incoming_media.select("id", "phash", "original_filename", "uploaded_at"))
    log = jobs.known_hashes(lib.spark, shared_folder(lib.spark, "ingest"))
    log.buckets = 8
    log.start(lib.existing_media.select("phash"))
    cuts = incoming.select(F.percentile_approx(F.unix_micros(F.col("uploaded_at").cast("timestamp")), [0.3, 0.6])).first()[0] or []
    number = sum((F.unix_micros(F.col("uploaded_at").cast("timestamp")) > c).cast("int") for c in cuts) if cuts else F.lit(0)
    out = None
    for i in range(len(cuts) + 1):
        batch = incoming.where(number == i)
        decided = durable(K.dedup_ingest(batch, log.before(i, batch.select("phash"))))
        created = decided.where(f"status = 'created' and phash <> '{S.NO_HASH}'").select("phash")
        log.put(i, created, created.limit(0))
        out = decided if out is None else out.unionByName(decided)
    return out.select("id", "status", "reason")


@query(
    "e9_ingest_report",
    """select strftime(uploaded_at, '%Y-%m-%d') as batch, count(*) as total,
    count(*) filter (where status = 'created') as done, count(*) filter (where status = 'duplicate') as skipped,
    count(*) filter (where status = 'rejected') as failed from decided group by 1""",
    DECISION_VIEWS,
)
def _(lib):
    batch = F.date_format("uploaded_at", "yyyy-MM-dd")
    return K.ingest_report(decided_batch(lib).withColumn("batch", batch))


@query(
    "e9_ingest_errors",
    """select strftime(uploaded_at, '%Y-%m-%d') as batch, original_filename, reason
    from decided where status = 'rejected'""",
    DECISION_VIEWS,
)
def _(lib):
    batch = F.date_format("uploaded_at", "yyyy-MM-dd")
    return K.ingest_errors(decided_batch(lib).withColumn("batch", batch))


@query(
    "k2_composite_fingerprint",
    """select conv_id as id, coalesce(string_agg(md5(text), '|' order by turn) filter (where length(text) >= 30), 'no_hash') as phash
    from conversations group by conv_id""",
)
def _(lib):
    frames = lib.conversations.select(
        F.col("conv_id").alias("id"), F.col("turn").alias("frame_no"),
        F.when(F.length("text") >= 30, F.md5("text")).alias("hash"),
    )
    return K.composite_fingerprint(frames.select("id").distinct(), frames)


@query(
    "k4_content_fingerprint",
    """select 'document' as kind, doc_id as id, sha256(text) as fingerprint from documents
    union all select 'page', page_id, sha256(html) from pages""",
)
def _(lib):
    docs = lib.documents.select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"),
        K.content_fingerprint(F.col("text")).alias("fingerprint"),
    )
    pages = lib.pages.select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"),
        K.content_fingerprint(F.col("html")).alias("fingerprint"),
    )
    return docs.unionByName(pages)


@query(
    "k5_duplicate_report",
    """select phash, count(*) as copies, arg_min(id, row(uploaded_at, id)) as kept_id
    from media where phash <> 'no_hash' group by phash having count(*) > 1""",
)
def _(lib):
    return K.duplicate_report(lib.media)


LAST = """(select media_id, favorite from (select *, row_number() over (partition by media_id order by seq desc) as rn
  from fav_changes) where rn = 1)"""


@query(
    "l1_set_favorites",
    f"""select media_id from favorites where media_id not in (select media_id from {LAST} where not favorite)
    union select media_id from {LAST} where favorite""",
)
def _(lib):
    return L.set_favorites(lib.favorites, lib.fav_changes)


@query(
    "l2_replace_tags",
    """select media_id, tag, is_auto, confidence from media_tags where media_id not in (select media_id from favorites)
    union all select media_id, tag, false, null from favorites, (values ('label_1'), ('kept')) t(tag)""",
)
def _(lib):
    return L.replace_tags(lib.media_tags, lib.favorites, [" label_1 ", "", "kept", "label_1"])


@query(
    "l2_replace_tags_each",
    """select media_id, tag, is_auto, confidence from media_tags where media_id not in (select media_id from favorites)
    union all select distinct f.media_id, c.type, false, cast(null as double) from favorites f join changes c on c.media_id = f.media_id""",
)
def _(lib):
    names = lib.changes.select("media_id", F.concat(F.lit(" "), "type").alias("tag"))
    return L.replace_tags(lib.media_tags, lib.favorites, names)


def merged_sql(scope: str) -> str:
    return f"""select media_id, tag, is_auto, confidence from media_tags where not is_auto
    union all select media_id, tag, is_auto, confidence from media_tags m where is_auto
      and not (tag in (select tag from predictions) and {scope})
      and not exists (select 1 from predictions p where p.tag = m.tag and p.media_id = m.media_id)
    union all select media_id, tag, true, confidence from predictions p
      where not exists (select 1 from media_tags m where not is_auto and m.tag = p.tag and m.media_id = p.media_id)"""


@query("l3_merge_auto_tags", merged_sql("true"))
def _(lib):
    return L.merge_auto_tags(lib.media_tags, lib.predictions, lib.predictions)


@query(
    "l3_merge_auto_tags_in_folder",
    merged_sql("media_id in (select media_id from folder_media where folder_id = 'src0')"),
)
def _(lib):
    scope = lib.folder_media.where("folder_id = 'src0'")
    return L.merge_auto_tags(lib.media_tags, lib.predictions, lib.predictions, scope)


@query(
    "l4_add_to_folder",
    """select 'row' as kind, folder_id, media_id as n from (select * from folder_media union select 'src1', media_id from favorites)
    union all select 'added', 'src1', count(*) from favorites
      where media_id not in (select media_id from folder_media where folder_id = 'src1') having count(*) > 0""",
)
def _(lib):
    new = lib.favorites.select(F.lit("src1").alias("folder_id"), "media_id")
    rows, counts = L.add_to_folder(lib.folder_media, new)
    return rows.select(F.lit("row").alias("kind"), "folder_id", F.col("media_id").alias("n")).unionByName(
        counts.select(F.lit("added").alias("kind"), "folder_id", F.col("added").alias("n"))
    )


@query(
    "l4_remove_from_folder",
    """with gone as (select folder_id, media_id from folder_media where media_id in (select media_id from favorites))
    select 'row' as kind, folder_id, media_id as n from folder_media where media_id not in (select media_id from favorites)
    union all select 'removed', folder_id, count(*) from gone group by folder_id""",
)
def _(lib):
    gone = lib.folders.select("folder_id").join(lib.folder_media, "folder_id").join(
        lib.favorites, "media_id", "left_semi"
    )
    rows, counts = L.remove_from_folder(lib.folder_media, gone)
    return rows.select(F.lit("row").alias("kind"), "folder_id", F.col("media_id").alias("n")).unionByName(
        counts.select(F.lit("removed").alias("kind"), "folder_id", F.col("removed").alias("n"))
    )


@query(
    "l5_delete_media",
    """with gone as (select distinct media_id from requested)
    select 'media' as part, id from media where id not in (select media_id from gone)
    union all select 'vectors', vec_id from embeddings where vec_id not in (select media_id from gone)
    union all select 'favorites', media_id from favorites where media_id not in (select media_id from gone)
    union all select 'folder_media', media_id from folder_media where media_id not in (select media_id from gone)
    union all select 'media_tags', media_id from media_tags where media_id not in (select media_id from gone)
    union all select 'deleted', count(*) from media where id in (select media_id from gone)""",
)
def _(lib):
    gone = lib.requested.select("media_id").distinct()
    left = L.delete_media(
        {
            "media": lib.media.select("id"),
            "vectors": lib.embeddings.select(F.col("vec_id").alias("id")),
            "favorites": lib.favorites,
            "folder_media": lib.folder_media.select("media_id"),
            "media_tags": lib.media_tags.select("media_id"),
        },
        gone,
    )
    out = L.deleted_count(lib.media, gone).select(
        F.lit("deleted").alias("part"), F.col("deleted").alias("id")
    )
    for part, df in left.items():
        out = out.union(df.select(F.lit(part), F.col(df.columns[0])))
    return out


@query(
    "l6_delete_folder",
    """select 'folder' as part, folder_id, cast(-1 as bigint) as media_id from folders where folder_id not in ('src0', 'src3')
    union all select 'member', folder_id, media_id from folder_media where folder_id not in ('src0', 'src3')""",
)
def _(lib):
    gone = lib.folders.where(F.col("folder_id").isin("src0", "src3"))
    folders, members = L.delete_folder(lib.folders, lib.folder_media, gone)
    return folders.select(
        F.lit("folder").alias("part"), "folder_id", F.lit(-1).cast("long").alias("media_id")
    ).unionByName(members.select(F.lit("member").alias("part"), "folder_id", "media_id"))


@query(
    "l7_create_folders",
    """with new as (select distinct 'lang_' || lang as folder_id, case when lang = 'de' then '  ' else ' ' || lang || ' ' end as name, lang as pos from documents)
    select folder_id, name, cast(sort_order as bigint) as sort_order from folders
    union all select folder_id, trim(name), (select max(sort_order) from folders) + row_number() over (order by pos, folder_id)
    from new where trim(name) <> ''""",
)
def _(lib):
    lang = F.col("lang")
    new = lib.documents.select(
        F.concat(F.lit("lang_"), lang).alias("folder_id"),
        F.when(lang == "de", "  ").otherwise(F.concat(F.lit(" "), lang, F.lit(" "))).alias("name"),
        lang.alias("pos"),
    ).distinct()
    return L.create_folders(lib.folders, new)


@query(
    "l7_rename_folders",
    """select folder_id, case when folder_id in ('src1', 'src2') then 'Best of ' || folder_id else name end as name from folders""",
)
def _(lib):
    names = lib.folders.select(
        "folder_id",
        F.when(F.col("folder_id").isin("src1", "src2"), F.concat(F.lit(" Best of "), "folder_id"))
        .otherwise(" ").alias("name"),
    )
    return L.rename_folders(lib.folders, names).select("folder_id", "name")


@query(
    "l7_reorder_folders",
    """with listed as (select folder_id, row_number() over (order by name desc) - 1 as pos from folders where folder_id <> 'src0')
    select f.folder_id, cast(coalesce(l.pos, f.sort_order) as bigint) as sort_order
    from folders f left join listed l on l.folder_id = f.folder_id""",
)
def _(lib):
    from lightbox.plans.ordered import positions

    listed = positions(lib.folders.where("folder_id <> 'src0'"), [], [F.col("name").desc()], "pos")
    listed = listed.select("folder_id", (F.col("pos") - 1).alias("pos"))
    return L.reorder_folders(lib.folders, listed).select("folder_id", "sort_order")


@query(
    "l8_update_media",
    """with changed as (select doc_id as id, 'new' || cast(doc_id as varchar) as phash, cast(quality as bigint) as size_bytes from labels)
    select 'media' as part, m.id, coalesce(c.phash, m.phash) as phash, coalesce(c.size_bytes, m.size_bytes) as n
    from media m left join changed c on c.id = m.id
    union all select 'vector', vec_id, '', cast(label as bigint) from embeddings
      where vec_id not in (select id from changed join media using (id))
    union all select 'vector', l.doc_id, '', cast(l.toxic as bigint) from labels l join media m on m.id = l.doc_id
      where l.toxic = 1""",
)
def _(lib):
    media = lib.media.select("id", "phash", "size_bytes")
    vectors = lib.embeddings.select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("long").alias("label"))
    changed = lib.labels.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("new"), "doc_id").alias("phash"),
        F.col("quality").cast("long").alias("size_bytes"),
    )
    new_vectors = lib.labels.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("toxic") == 1, F.array(F.lit(1.0).cast("float"))).alias("embedding"),
        F.col("toxic").cast("long").alias("label"),
    )
    m, v = L.update_media(media, vectors, changed, new_vectors)
    return m.select(F.lit("media").alias("part"), "id", "phash", F.col("size_bytes").alias("n")).unionByName(
        v.select(F.lit("vector").alias("part"), "id", F.lit("").alias("phash"), F.col("label").alias("n"))
    )


@query(
    "l9_repair_media",
    """select id, case when bad then 'h' || cast(id as varchar) else phash end as phash,
      case when bad then cast(id + 1 as int) else width end as width,
      case when bad then null else exif_json end as exif_json,
      strftime(case when bad and id % 2 = 0 then uploaded_at else original_date end, '%Y-%m-%d %H:%M:%S') as original_date, bad as repaired
    from (select *, phash = 'no_hash' and id % 3 <> 0 as bad from catalog)""",
    CATALOG_VIEWS,
)
def _(lib):
    media = C.derive_catalog(lib.media)
    readable = C.unhashed_media(media).where("id % 3 <> 0")
    fresh = readable.select(
        "id", F.concat(F.lit("h"), "id").alias("phash"), (F.col("id") + 1).cast("int").alias("width"),
        "height", F.lit(None).cast("string").alias("exif_json"),
        F.when(F.col("id") % 2 == 0, F.col("uploaded_at")).alias("original_date"),
    )
    out, fixed = L.repair_media(media, fresh)
    marks = fixed.select("id", F.lit(True).alias("_r"))
    return out.join(marks, "id", "left").select(
        "id", "phash", "width", "exif_json", ts_text(F.col("original_date")).alias("original_date"),
        F.col("_r").isNotNull().alias("repaired"),
    )


# Vectors of repaired items: replaced where the file gave one, kept elsewhere.
@query(
    "l9_repair_vectors",
    """select vec_id as id, case when vec_id in (select id from media where phash = 'no_hash' and id % 3 = 1)
      then 'new' else 'old' end as origin, len(embedding) as width from embeddings""",
)
def _(lib):
    media = C.derive_catalog(lib.media)
    readable = C.unhashed_media(media).where("id % 3 <> 0")
    fresh = readable.select(
        "id", F.lit("h").alias("phash"), "width", "height", "exif_json", "original_date",
        F.when(F.col("id") % 3 == 1, F.array_repeat(F.lit(2.0).cast("float"), 64)).alias("embedding"),
    )
    vectors = lib.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    _, fixed = L.repair_media(media, fresh)
    out = L.repair_vectors(vectors, fixed, fresh.join(vectors.select("id"), "id", "left_semi"))
    new = F.forall("embedding", lambda x: x == 2.0)
    return out.select("id", F.when(new, "new").otherwise("old").alias("origin"), F.size("embedding").cast("long").alias("width"))
