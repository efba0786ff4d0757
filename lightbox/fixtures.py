"""Library tables derived from the driver tables.

The SQL is the subset shared by Spark and the check engine, so both sides of a
check read the same library. Views may use the views before them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = (
    "documents", "labels", "embeddings", "events", "orders", "part", "pages", "conversations",
)

VIEWS: dict[str, str] = {
    "media": """
select d.doc_id as id,
  case d.doc_id % 6
    when 0 then 'IMG_' || replace(substr(cast(o.o_orderdate as string),1,10),'-','') || '_134530.jpg'
    when 1 then 'VID_' || replace(substr(cast(o.o_orderdate as string),1,10),'-','') || '_080910.mp4'
    when 2 then 'up/Screenshot ' || substr(cast(o.o_orderdate as string),1,10) || '.png'
    when 3 then 'PXL_' || replace(substr(cast(o.o_orderdate as string),1,10),'-','') || '_235959123.JPG'
    when 4 then 'notes_' || cast(d.doc_id as string) || '.txt'
    else 'scan' || cast(d.doc_id % 7 as string) || '.webp' end as original_filename,
  case when d.doc_id % 50 = 7 then 'no_hash' else md5(d.text) end as phash,
  e.ts as uploaded_at, d.n_chars as size_bytes,
  cast(100 + (d.doc_id * 37) % 70000 as int) as width, cast(100 + (d.doc_id * 91) % 5000 as int) as height,
  cast(d.doc_id % 9 as int) as orientation,
  case d.doc_id % 4
    when 0 then '{"DateTimeOriginal":"' || replace(substr(cast(o.o_orderdate as string),1,10),'-',':') || ' 12:30:00","Make":"Cam' || cast(d.doc_id % 5 as string) || '"}'
    when 1 then '{"DateTimeOriginal":"unknown","DateTimeDigitized":"' || substr(cast(o.o_orderdate as string),1,10) || '"}'
    when 2 then null else 'not json' end as exif_json
from documents d join orders o on o.o_orderkey = d.doc_id join events e on e.event_id = d.doc_id""",
    "folders": """
select source as folder_id, 'Folder ' || source as name, row_number() over (order by source) - 1 as sort_order
from (select distinct source from documents) s""",
    "folder_media": """
select source as folder_id, doc_id as media_id from documents
union select 'src0' as folder_id, doc_id as media_id from documents where doc_id % 7 = 0""",
    "favorites": "select doc_id as media_id from labels where quality = 1 and toxic = 0",
    "media_tags": """
select doc_id as media_id, lang as tag, false as is_auto, cast(null as double) as confidence from documents where doc_id % 3 = 0
union all select vec_id, 'label_' || cast(label as string), false, cast(null as double) from embeddings where vec_id % 4 = 0
union all select vec_id, 'label_' || cast(label as string), true, cast((50 + vec_id % 50) / 100.0 as double) from embeddings where vec_id % 10 = 1""",
    "changes": """
select event_id as seq, ts, user_id as media_id,
  case event_type when 'signup' then 'MediaCreated' when 'view' then 'MediaUpdated' when 'click' then 'MediaTagsUpdated'
    when 'purchase' then 'MediaAddedToFolder' else 'MediaDeleted' end as type, value, props from events""",
    "predictions": """
select 'label_' || cast(label as string) as tag, vec_id as media_id, cast((40 + vec_id % 60) / 100.0 as double) as confidence
from embeddings where vec_id % 6 in (0, 1)""",
    "models": """
select 'label_' || cast(e.label as string) as tag, e.embedding as weights,
  cast(0.05 as double) as bias, cast(-2.0 as double) as platt_a, cast(0.1 as double) as platt_b,
  case when e.label % 2 = 0 then c.n else 0 end as trained_at_count, 1 as version
from embeddings e
join (select min(vec_id) as vec_id from embeddings group by label) f on f.vec_id = e.vec_id
join (select tag, count(*) as n from media_tags where not is_auto group by tag) c
  on c.tag = 'label_' || cast(e.label as string)""",
    "feed": """
select event_id as seq, ts, user_id, event_type,
  case when event_id % 101 = 0 then 'not json'
    when event_id % 103 = 0 then '{"type":"Unknown","data":{}}'
    when event_id % 107 = 0 then '{"type":"MediaUpdated","data":{"name":"x"}}'
    when event_id % 13 = 5 then case event_id % 9
      when 0 then '{"type":"FullRefresh","data":{}}' when 1 then '{"type":"UploadComplete","data":{}}'
      when 2 then '{"type":"TagLearningComplete","data":{"tag_name":"en"}}' when 3 then '{"type":"ThumbnailFixStarted","data":{}}'
      when 4 then '{"type":"ThumbnailFixCompleted","data":{"count":3}}' when 5 then '{"type":"FolderCreated","data":{"folder":"f"}}'
      when 6 then '{"type":"FolderDeleted","data":{"id":"' || cast(user_id as string) || '"}}'
      when 7 then '{"type":"FolderRenamed","data":{"id":"' || cast(user_id as string) || '","name":"n"}}'
      else '{"type":"FoldersReordered","data":{"ids":["' || cast(user_id as string) || '"]}}' end
    when event_type = 'signup' then '{"type":"MediaCreated","data":{"item":{"id":"' || cast(user_id as string) || '","size_bytes":' || cast(event_id as string)
      || ',"media_type":"image","is_favorite":' || case when event_id % 2 = 0 then 'true' else 'false' end
      || ',"tags":[{"name":"' || case when event_id % 3 = 0 then 'de' else 'en' end || '","is_auto":false}]}}}'
    when event_type = 'view' then '{"type":"MediaUpdated","data":{"id":"' || cast(user_id as string) || '","item":{' || case when event_id % 4 = 0 then '"is_favorite":true'
      else '"size_bytes":' || cast(event_id as string) end || '}}}'
    when event_type = 'click' then '{"type":"MediaTagsUpdated","data":{"ids":["' || cast(user_id as string) || '","' || cast(user_id + 1 as string) || '"],"tags":["x"'
      || case when event_id % 5 = 0 then '' else ',"en"' end || ']}}'
    when event_type = 'purchase' then '{"type":"MediaAddedToFolder","data":{"folder_id":"src' || cast(user_id % 20 as string) || '","media_ids":["' || cast(user_id as string) || '"]}}'
    when event_id % 3 = 0 then '{"type":"MediaDeleted","data":{"id":"' || cast(user_id as string) || '"}}'
    when event_id % 3 = 1 then '{"type":"MediaBatchDeleted","data":{"ids":["' || cast(user_id as string) || '","' || cast(user_id + 2 as string) || '"]}}'
    else '{"type":"MediaRemovedFromFolder","data":{"folder_id":"src' || cast(user_id % 20 as string) || '","media_ids":["' || cast(user_id as string) || '","' || cast(user_id + 1 as string) || '"]}}'
  end as value
from events""",
    "existing_media": "select * from media where id % 2 = 0 and id % 6 <> 4",
    "incoming_media": "select * from media where id % 2 = 1 or id % 6 = 4",
    "requested": "select event_id as pos, user_id as media_id from events",
    "fav_changes": """
select event_id as seq, ts, user_id as media_id, value >= 10.0 as favorite from events where event_type = 'click'""",
}


def _words(sql: str) -> set[str]:
    return set(re.findall(r"[a-z_0-9]+", sql))


def needed_views(sql: str, extra: dict[str, str] | None = None) -> list[str]:
    """Names of the views ``sql`` reads, directly or through other views, in order."""
    pool = {**VIEWS, **(extra or {})}
    found: set[str] = set()
    todo = _words(sql) & pool.keys()
    while todo:
        found |= todo
        todo = set().union(*(_words(pool[name]) for name in todo)) & pool.keys() - found
    return [name for name in pool if name in found]


def check_sql(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` with every library view it reads inlined as a common table expression."""
    pool = {**VIEWS, **(extra or {})}
    names = needed_views(sql, extra)
    recursive = "recursive " if "/*recursive*/" in sql else ""
    head = f"with {recursive}" + ",\n".join(f"{n} as ({pool[n]})" for n in names)
    body = sql.strip().replace("/*recursive*/", "")
    if not names:
        return f"with {recursive}" + body[5:] if body.startswith("with ") else body
    return f"{head},\n{body[5:]}" if body.startswith("with ") else f"{head}\n{body}"


class Library:
    """Lazily built library tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in BASE_TABLES:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name == "media":
                self._cache[name] = self._media()
            elif name in VIEWS:
                self._cache[name] = self.sql(VIEWS[name])
            else:
                raise AttributeError(name)
        return self._cache[name]

    def _media(self) -> DataFrame:
        """The view ``media``, with texts hashed where they are read.

        As the statement stands, Spark hashes after the joins and shuffles every whole text for it.
        """
        hashed = self.documents.select("doc_id", "n_chars", F.md5("text").alias("text_md5"))
        return self.sql(VIEWS["media"].replace("md5(d.text)", "d.text_md5"), documents=hashed)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Run ``text`` with the tables it names bound to this library, or to ``frames`` of their names.

        Braces of JSON text in the statement are doubled, because the statement
        passes through Python formatting to bind the tables.
        """
        used = [t for t in (*BASE_TABLES, *VIEWS) if re.search(rf"\b(from|join)\s+{t}\b", text)]
        bound = text.replace("{", "{{").replace("}", "}}")
        for table in used:
            bound = re.sub(rf"\b(from|join)\s+{table}\b", rf"\1 {{{table}}}", bound)
        return self.spark.sql(bound, **{t: frames[t] if t in frames else getattr(self, t) for t in used})
