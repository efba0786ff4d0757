"""Storage, codecs and plug points over content taken from the tables."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lightbox.functions import images as O
from lightbox.functions import vectors as V
from lightbox.operators import catalog as C
from lightbox.session import durable, shared_folder, temporary_tables
from lightbox.sources import files, tables
from lightbox.workload.registry import query
from lightbox.workload.scalars import CATALOG_VIEWS, ts_text


def scratch(lib) -> str:
    """A new folder beside the checkpoints, on storage every executor sees."""
    return shared_folder(lib.spark, "library")


def stored_media(lib):
    return C.derive_catalog(lib.media).select(
        F.col("id").cast("string").alias("id"), F.col("original_filename").alias("filename"),
        "original_filename", "media_type", "phash", "uploaded_at", "original_date", "width", "height",
        "size_bytes", "exif_json",
    )


# Every table of a stored library: rows, and nulls of the columns that older files lack.
@query(
    "a1_load_library_tables",
    """select 'media' as name, count(*) as n, 0 as filled from media
    union all select 'vectors', count(*), 0 from embeddings
    union all select 'folders', count(*), count(*) from folders
    union all select 'folder_media', count(*), 0 from folder_media
    union all select 'favorites', count(*), 0 from favorites
    union all select 'tags', count(distinct tag), 0 from media_tags
    union all select 'media_tags', count(*), count(*) from media_tags
    union all select 'tag_models', count(*), count(*) from models""",
)
def _(lib):
    root = scratch(lib)
    tag_id = F.dense_rank().over(Window.orderBy("tag")).cast("long")
    tags = lib.media_tags.select("tag").distinct().withColumn("tag_id", tag_id)
    text = F.col("media_id").cast("string").alias("media_id")
    stored = {
        "media": stored_media(lib), "vectors": lib.embeddings.select(F.col("vec_id").cast("string").alias("id"), "embedding"),
        "folders": lib.folders.drop("sort_order"), "folder_media": lib.folder_media.select("folder_id", text),
        "favorites": lib.favorites.select(text), "tags": tags,
        "media_tags": lib.media_tags.join(tags, "tag").select(text, "tag_id"),
        "tag_models": lib.models.join(tags, "tag").select("tag_id", "weights", "bias"),
    }
    for name, rows in stored.items():
        rows.write.parquet(f"{root}/{name}")
    # Columns that these files lack come back with their defaults.
    defaults = {"folders": "sort_order = 0", "media_tags": "not is_auto and confidence is null", "tag_models": "platt_a = -2.0 and version = 1"}
    out = None
    for name, rows in tables.load_library(lib.spark, root).items():
        filled = F.count_if(F.expr(defaults.get(name, "false")))
        one = rows.agg(F.count("*").alias("n"), filled.alias("filled")).select(F.lit(name).alias("name"), "n", "filled")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "a1_load_library",
    """select cast(id as varchar) as id, media_type, strftime(original_date, '%Y-%m-%d %H:%M:%S') as original_date, size_bytes,
    c.id in (select media_id from favorites) as is_favorite from catalog c""",
    CATALOG_VIEWS,
)
def _(lib):
    root = scratch(lib)
    stored_media(lib).write.parquet(f"{root}/media")
    lib.favorites.write.parquet(f"{root}/favorites")
    media = tables.load_table(lib.spark, root, "media")
    favorites = tables.load_table(lib.spark, root, "favorites")
    return C.with_favorites(media, favorites).select(
        "id", "media_type", ts_text(F.col("original_date")).alias("original_date"), "size_bytes", "is_favorite"
    )


@query(
    "a2_ingest_files",
    """select source, cast(sum(octet_length(encode(text)) + 1) as bigint) as size_bytes,
    cast(sum(octet_length(encode(text)) + 1) as bigint) as read_bytes, count(*) as records from documents group by source""",
)
def _(lib):
    root = scratch(lib)
    # A folder per source, each file bounded in records, whatever a source holds.
    lib.documents.select(F.col("text").alias("value"), "source").write.partitionBy("source").option(
        "maxRecordsPerFile", 1000
    ).option("lineSep", "\x00").text(root)
    text = F.decode("content", "UTF-8")
    marks = F.length(text) - F.length(F.replace(text, F.lit("\x00"), F.lit("")))
    return files.ingest_files(lib.spark, root, "part-*").groupBy(
        F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")
    ).agg(
        F.sum("size_bytes").alias("size_bytes"), F.sum(F.length("content")).alias("read_bytes"),
        F.sum(marks).cast("long").alias("records"),
    )


@query(
    "a3_append_media",
    """select 'media' as part, cast(id as varchar) as id from media
    union all select 'vectors', cast(vec_id as varchar) from embeddings where vec_id in (select id from media)""",
)
def _(lib):
    root = scratch(lib)
    vectors = lib.embeddings.select(F.col("vec_id").cast("string").alias("id"), "embedding")
    with temporary_tables(lib.spark):
        # Four writes read the items; their joins run once.
        media = durable(stored_media(lib))
        for kind in ("image", "video"):
            rows = C.filter_media_type(media, kind)
            tables.append_media(rows, rows.select("id").join(vectors, "id", "left"), root)
    return (
        tables.load_table(lib.spark, root, "media").select(F.lit("media").alias("part"), "id")
        .unionByName(tables.load_table(lib.spark, root, "vectors").select(F.lit("vectors").alias("part"), "id"))
    )


@query(
    "a4_vector_codec",
    "select vec_id as id, len(embedding) * 4 as bytes, round(list_sum(cast(embedding as double[])), 6) as total from embeddings",
)
def _(lib):
    raw = lib.embeddings.select(
        F.col("vec_id").alias("id"), V.encode_vectors(F.col("embedding")).alias("raw")
    )
    back = raw.select("id", F.length("raw").cast("long").alias("bytes"), V.decode_vectors(F.col("raw")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return back.select("id", "bytes", F.round(total, 6).alias("total"))


def picture_rows(lib):
    """Each vector drawn as a gray picture of eight pixel rows, in the image source's layout."""
    level = F.transform(
        "embedding", lambda x: F.least(F.greatest(F.floor((x + 0.5) * 255), F.lit(0)), F.lit(255))
    )
    text = F.array_join(F.transform(level, lambda v: F.lpad(F.hex(v), 2, "0")), "")
    return lib.embeddings.select(
        F.col("vec_id").alias("id"),
        F.struct(
            F.lit(8).alias("height"), (F.size("embedding") / 8).cast("int").alias("width"),
            F.lit(1).alias("nChannels"), F.unhex(text).alias("data"),
        ).alias("image"),
    )


@query("k3_image_fingerprint")
def _(lib):
    return picture_rows(lib).select("id", O.image_fingerprint(F.col("image")).alias("phash"))


@query(
    "o1_feature_extractor",
    """select doc_id as id, octet_length(encode(text)) as bytes,
    cast(len(text) - len(replace(text, ' ', '')) as bigint) as spaces from documents""",
)
def _(lib):
    def factory():
        return lambda raw: [len(raw), raw.count(b" ")]

    rows = lib.documents.select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("content"))
    out = O.feature_extractor(rows, factory)
    return out.select(
        "id", F.element_at("embedding", 1).cast("long").alias("bytes"),
        F.element_at("embedding", 2).cast("long").alias("spaces"),
    )


@query(
    "o2_hash_generator",
    """select page_id as id, case when page_id % 10 = 3 then 'no_hash' else md5(html) end as phash from pages""",
)
def _(lib):
    content = F.when(F.col("page_id") % 10 != 3, F.encode("html", "UTF-8"))
    return lib.pages.select(
        F.col("page_id").alias("id"),
        O.hash_generator(content, lambda raw: hashlib.md5(raw).hexdigest()).alias("phash"),
    )


@query("o3_extract_embeddings")
def _(lib):
    def factory():
        return lambda batch: np.stack([batch.mean(axis=(1, 2, 3)), batch.std(axis=(1, 2, 3))], axis=1)

    out = O.extract_embeddings(picture_rows(lib), factory)
    return out.select(
        "id", F.round(F.element_at("embedding", 1).cast("double"), 3).alias("mean"),
        F.round(F.element_at("embedding", 2).cast("double"), 3).alias("spread"),
    )
