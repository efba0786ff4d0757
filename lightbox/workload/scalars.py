"""Queries over single rows: names, dates, units, metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from lightbox.functions import scalars as S
from lightbox.workload.registry import query

# Derived columns of the catalog, spelled for the check engine.
CATALOG_VIEWS = {
    "named": r"""
select m.*,
  regexp_extract(original_filename, '([^/]*)/*$', 1) as base,
  regexp_extract(original_filename, '([^/\\]*)$', 1) as leaf
from media m""",
    "typed": r"""
select n.*,
  case when regexp_matches(base, '^.+\.[^.]*$') then lower(regexp_extract(base, '^.+\.([^.]*)$', 1)) else 'bin' end as ext,
  regexp_replace(regexp_replace(leaf, '\.[^.]*$', ''), '[^0-9]', '', 'g') as digits,
  case when json_valid(exif_json) then json_extract_string(exif_json, '$.DateTimeOriginal') end as x1,
  case when json_valid(exif_json) then json_extract_string(exif_json, '$.DateTimeDigitized') end as x2,
  case when json_valid(exif_json) then json_extract_string(exif_json, '$.DateTime') end as x3
from named n""",
    "dated": r"""
select t.*,
  coalesce(
    case when length(digits) >= 14 then try_strptime(substr(digits,1,14), '%Y%m%d%H%M%S') end,
    case when length(digits) >= 8 then try_strptime(substr(digits,1,8), '%Y%m%d') end) as name_ts,
  coalesce(
    try_strptime(replace(trim(x1),'/','-'), ['%Y:%m:%d %H:%M:%S','%Y-%m-%d %H:%M:%S','%Y:%m:%d','%Y-%m-%d']),
    try_strptime(replace(trim(x2),'/','-'), ['%Y:%m:%d %H:%M:%S','%Y-%m-%d %H:%M:%S','%Y:%m:%d','%Y-%m-%d']),
    try_strptime(replace(trim(x3),'/','-'), ['%Y:%m:%d %H:%M:%S','%Y-%m-%d %H:%M:%S','%Y:%m:%d','%Y-%m-%d'])) as exif_ts
from typed t""",
    "catalog": r"""
select id, original_filename, phash, uploaded_at, size_bytes, width, height, orientation, exif_json, ext,
  case when ext in ('mp4','mov','avi','mkv','webm') then 'video' else 'image' end as media_type,
  coalesce(exif_ts, case when year(name_ts) between 1970 and 2100 then name_ts end, uploaded_at) as original_date
from dated""",
}


def ts_text(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def sql_query(name, sql):
    return query(name, sql, CATALOG_VIEWS)


@sql_query("b1_file_extension", "select id, original_filename, ext from typed")
def _(lib):
    return lib.media.select(
        "id", "original_filename", S.file_extension(F.col("original_filename")).alias("ext")
    )


@sql_query("b2_media_type", "select id, media_type from catalog")
def _(lib):
    return lib.media.select(
        "id", S.media_type(S.file_extension(F.col("original_filename"))).alias("media_type")
    )


@sql_query(
    "b3_allowed_extension",
    """select id, ext in ('jpg','jpeg','png','gif','webp','bmp','tiff','tif','heic','heif','avif','mp4','mov','avi','mkv','webm') as allowed,
    case when not (ext in ('jpg','jpeg','png','gif','webp','bmp','tiff','tif','heic','heif','avif','mp4','mov','avi','mkv','webm'))
      then 'File type not allowed: .' || ext end as reason
    from typed""",
)
def _(lib):
    ext = S.file_extension(F.col("original_filename"))
    return lib.media.select(
        "id", S.allowed_extension(ext).alias("allowed"), S.rejection_reason(ext).alias("reason")
    )


@sql_query(
    "b4_date_from_filename",
    """select id, strftime(case when year(name_ts) between 1970 and 2100 then name_ts end,
    '%Y-%m-%d %H:%M:%S') as name_date from dated""",
)
def _(lib):
    return lib.media.select(
        "id", ts_text(S.date_from_filename(F.col("original_filename"))).alias("name_date")
    )


@sql_query(
    "b5_parse_exif_datetime",
    """with texts as (
      select e.event_id as id, case e.event_id % 5
        when 0 then '  ' || strftime(e.ts, '%Y:%m:%d %H:%M:%S')
        when 1 then strftime(e.ts, '%Y/%m/%d %H:%M:%S') || ' '
        when 2 then strftime(e.ts, '%Y:%m:%d')
        when 3 then strftime(e.ts, '%Y/%m/%d') else e.props end as text from events e)
    select id, strftime(try_strptime(replace(trim(text),'/','-'),
      ['%Y:%m:%d %H:%M:%S','%Y-%m-%d %H:%M:%S','%Y:%m:%d','%Y-%m-%d']), '%Y-%m-%d %H:%M:%S') as parsed
    from texts""",
)
def _(lib):
    ts = F.col("ts")
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("  "), F.date_format(ts, "yyyy:MM:dd HH:mm:ss")))
        .when(kind == 1, F.concat(F.date_format(ts, "yyyy/MM/dd HH:mm:ss"), F.lit(" ")))
        .when(kind == 2, F.date_format(ts, "yyyy:MM:dd"))
        .when(kind == 3, F.date_format(ts, "yyyy/MM/dd"))
        .otherwise(F.col("props"))
    )
    return lib.events.select(
        F.col("event_id").alias("id"), ts_text(S.parse_exif_datetime(text)).alias("parsed")
    )


@sql_query(
    "b6_exif_original_date",
    "select id, strftime(exif_ts, '%Y-%m-%d %H:%M:%S') as exif_date from dated",
)
def _(lib):
    return lib.media.select(
        "id", ts_text(S.exif_original_date(F.col("exif_json"))).alias("exif_date")
    )


@sql_query(
    "b7_resolve_original_date",
    "select id, strftime(original_date, '%Y-%m-%d %H:%M:%S') as original_date from catalog",
)
def _(lib):
    date = S.resolve_original_date(
        F.col("exif_json"), F.col("original_filename"), F.col("uploaded_at")
    )
    return lib.media.select("id", ts_text(date).alias("original_date"))


@sql_query(
    "b8_exif_entries",
    """with doc as (select id, cast(exif_json as json) as j from media where json_valid(exif_json)),
    keyed as (select id, j, unnest(json_keys(j)) as k from doc)
    select id, k as entry, json_extract_string(j, '$.' || k) as text from keyed""",
)
def _(lib):
    return lib.media.select(
        "id", F.explode(S.exif_map(F.col("exif_json"))).alias("entry", "text")
    )


@sql_query(
    "b9_oriented_dims",
    """select id, case when orientation between 5 and 8 then height else width end as width,
    case when orientation between 5 and 8 then width else height end as height from media""",
)
def _(lib):
    dims = [F.col(c) for c in ("width", "height", "orientation")]
    return lib.media.select(
        "id", S.oriented_width(*dims).alias("width"), S.oriented_height(*dims).alias("height")
    )


@sql_query(
    "b10_decode_guard",
    """select id, width <= 65000 and height <= 65000
      and cast(width as bigint) * height * 4 <= 524288000 as decodable from media""",
)
def _(lib):
    return lib.media.select(
        "id", S.decode_allowed(F.col("width"), F.col("height")).alias("decodable")
    )


@sql_query(
    "b11_sanitize_filename",
    r"""with names as (select id, case id % 4 when 0 then '../"' || original_filename || '''' when 1 then chr(9) || ' /\ '
        else ' ' || original_filename || ' ' end as raw from media),
    clean as (select id, trim(regexp_replace(raw, '[\x00-\x1f\x7f-\x{9f}/\\"'']', '', 'g')) as n from names)
    select id, case when n = '' then 'download' else n end as name from clean""",
)
def _(lib):
    raw = (
        F.when(F.col("id") % 4 == 0, F.concat(F.lit('../"'), "original_filename", F.lit("'")))
        .when(F.col("id") % 4 == 1, F.lit("\t /\\ "))
        .otherwise(F.concat(F.lit(" "), "original_filename", F.lit(" ")))
    )
    return lib.media.select("id", S.sanitize_filename(raw).alias("name"))


@sql_query(
    "b12_safe_archive_name",
    """with names as (select id, case when id % 5 = 4 then '!!' else '_' || original_filename || ' (' || cast(id as varchar) || ')' end as raw from media),
    safe as (select id, trim(regexp_replace(raw, '[^A-Za-z0-9._-]', '_', 'g'), '_') as n from names)
    select id, case when n = '' then 'folder' else n end as name from safe""",
)
def _(lib):
    raw = F.when(F.col("id") % 5 == 4, "!!").otherwise(
        F.concat(F.lit("_"), "original_filename", F.lit(" ("), "id", F.lit(")"))
    )
    return lib.media.select("id", S.safe_archive_name(raw).alias("name"))


@sql_query(
    "b13_similarity_to_distance",
    """select event_id as id, round(2.0 * (1.0 - value / 100.0), 6) as open_distance,
    round(greatest(0.0, least(2.0, 2.0 * (1.0 - value / 100.0))), 6) as distance from events""",
)
def _(lib):
    value = F.col("value")
    return lib.events.select(
        F.col("event_id").alias("id"),
        F.round(S.similarity_to_distance(value, clamp=False), 6).alias("open_distance"),
        F.round(S.similarity_to_distance(value), 6).alias("distance"),
    )


@sql_query(
    "b14_parse_tag_list",
    """with texts as (select media_id, case when media_id % 5 = 0 then ''
        else ' ' || tag || ', ,' || case when is_auto then 'auto' else '' end || ',fr ' end as text from media_tags)
    select media_id, text, case when length(text) > 0 then
      array_to_string(list_filter(list_transform(string_split(text, ','), lambda t: trim(t)), lambda t: t <> ''), '|') end as names
    from texts""",
)
def _(lib):
    text = F.when(F.col("media_id") % 5 == 0, "").otherwise(
        F.concat(
            F.lit(" "), "tag", F.lit(", ,"),
            F.when(F.col("is_auto"), "auto").otherwise(""), F.lit(",fr "),
        )
    )
    return lib.media_tags.select(
        "media_id", text.alias("text"), F.array_join(S.parse_tag_list(text), "|").alias("names")
    )


@sql_query(
    "b15_format_bytes",
    """with sized as (select id, size_bytes * case id % 4 when 0 then 1 when 1 then 1024 when 2 then 1048576 else 0 end as n from media),
    scaled as (select id, n, case when n > 0 then cast(floor(ln(n) / ln(1024.0)) as int) end as u from sized)
    select id, case when n = 0 then '0 B' when u = 0 then cast(n as varchar) || ' B'
      else printf('%.1f', round(n / pow(1024.0, u), 1)) || ' ' || (['B','KB','MB','GB','TB'])[u + 1] end as size from scaled""",
)
def _(lib):
    factor = (
        F.when(F.col("id") % 4 == 0, 1).when(F.col("id") % 4 == 1, 1024)
        .when(F.col("id") % 4 == 2, 1048576).otherwise(0)
    )
    return lib.media.select("id", S.format_bytes(F.col("size_bytes") * factor).alias("size"))


@sql_query(
    "a6_storage_path",
    """select id, substr(md5(cast(id as varchar)),1,2) || '/' || substr(md5(cast(id as varchar)),3,2) || '/'
      || md5(cast(id as varchar)) || '.' || ext as path,
    substr(md5(cast(id as varchar)),1,2) || '/' || substr(md5(cast(id as varchar)),3,2) || '/'
      || md5(cast(id as varchar)) || '.jpg' as thumbnail from typed""",
)
def _(lib):
    key = F.md5(F.col("id").cast("string"))
    ext = S.file_extension(F.col("original_filename"))
    return lib.media.select(
        "id",
        S.storage_path(key, ext).alias("path"),
        S.storage_path(key, F.lit("jpg")).alias("thumbnail"),
    )
