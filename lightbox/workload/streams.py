"""Batch twins of the streaming operators over the change feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from lightbox.operators import catalog as C
from lightbox.session import durable, shared_folder
from lightbox.streaming import feed as N
from lightbox.streaming import jobs
from lightbox.streaming import windows as W
from lightbox.workload.registry import query

PARSED_VIEWS = {
    "parsed": r"""
select seq, ts, j, json_extract_string(j, '$.type') as kind from
(select seq, ts, case when json_valid(value) then cast(value as json) end as j from feed)""",
    "event_ids": r"""
select seq, ts, j, kind, unnest(case when kind = 'MediaCreated' then [json_extract_string(j, '$.data.item.id')]
  when kind in ('MediaUpdated', 'MediaDeleted', 'FolderDeleted', 'FolderRenamed') then [json_extract_string(j, '$.data.id')]
  when kind in ('MediaBatchDeleted', 'MediaTagsUpdated', 'FoldersReordered') then from_json(json_extract(j, '$.data.ids'), '["VARCHAR"]')
  else from_json(json_extract(j, '$.data.media_ids'), '["VARCHAR"]') end) as id
from parsed where kind is not null and kind <> 'Unknown'
  and not (kind = 'MediaUpdated' and json_extract_string(j, '$.data.id') is null)""",
}


def events(lib):
    return N.parse_changes(lib.feed.select("seq", "ts", "value"))


@query(
    "n1_parse_changes",
    r"""select p.seq, coalesce(p.kind, '') as type,
      case when p.kind is null then 'unreadable' when p.kind = 'Unknown' then 'unknown type'
        when p.kind = 'MediaUpdated' and not exists (select 1 from event_ids e where e.seq = p.seq) then 'missing id' else '' end as reason,
      coalesce((select string_agg(id, ',' order by cast(id as bigint)) from event_ids e where e.seq = p.seq), '') as ids,
      coalesce(json_extract_string(p.j, '$.data.folder_id'), '') as folder_id,
      coalesce(array_to_string(from_json(json_extract(p.j, '$.data.tags'), '["VARCHAR"]'), ','), '') as tags,
      coalesce(cast(json_extract_string(p.j, '$.data.item.size_bytes') as bigint), -1) as size_bytes
    from parsed p""",
    PARSED_VIEWS,
)
def _(lib):
    empty = F.lit("")
    return events(lib).select(
        "seq", F.coalesce("type", empty).alias("type"), F.coalesce("reason", empty).alias("reason"),
        F.coalesce(F.array_join("ids", ","), empty).alias("ids"),
        F.coalesce("folder_id", empty).alias("folder_id"),
        F.coalesce(F.array_join("tags", ","), empty).alias("tags"),
        F.coalesce("item.size_bytes", F.lit(-1)).alias("size_bytes"),
    )


# The listing replayed event by event.
REPLAY = (
    r"""with replay(id, n, shown, size_bytes, is_favorite, tags) as (
      select id, cast(0 as bigint), shown, size_bytes, is_favorite, tags from start
      union all select r.id, e.n,
        case when e.action = 'delete' then false
          when r.shown then list_contains(coalesce(e.tags, r.tags), 'en')
          else e.action = 'create' and coalesce(list_contains(e.tags, 'en'), false) end,
        case when r.shown then coalesce(e.size_bytes, r.size_bytes) else e.size_bytes end,
        case when r.shown then coalesce(e.is_favorite, r.is_favorite) else e.is_favorite end,
        case when r.shown then coalesce(e.tags, r.tags) else e.tags end
      from replay r join ev e on e.id = r.id and e.n = r.n + 1),
    final as (select *, row_number() over (partition by id order by n desc) as back from replay)
    select id, size_bytes, coalesce(is_favorite, false) as is_favorite, array_to_string(tags, '|') as tags from final
    where back = 1 and shown /*recursive*/""",
    {
        **PARSED_VIEWS,
        "ev": r"""
select id, row_number() over (partition by id order by seq) as n,
  case kind when 'MediaCreated' then 'create' when 'MediaDeleted' then 'delete' when 'MediaBatchDeleted' then 'delete' else 'update' end as action,
  cast(json_extract_string(j, '$.data.item.size_bytes') as bigint) as size_bytes,
  cast(json_extract_string(j, '$.data.item.is_favorite') as boolean) as is_favorite,
  case when kind = 'MediaTagsUpdated' then from_json(json_extract(j, '$.data.tags'), '["VARCHAR"]')
    when kind = 'MediaCreated' then [json_extract_string(j, '$.data.item.tags[0].name')] end as tags
from event_ids where kind in ('MediaCreated', 'MediaUpdated', 'MediaDeleted', 'MediaBatchDeleted', 'MediaTagsUpdated')""",
        "base_view": """
select cast(m.id as varchar) as id, m.size_bytes, m.id in (select media_id from favorites) as is_favorite, list(t.tag order by t.tag) as tags
from media m join (select distinct media_id, tag from media_tags) t on t.media_id = m.id
where m.id in (select media_id from media_tags where tag = 'en') group by m.id, m.size_bytes""",
        "start": """
select coalesce(b.id, i.id) as id, b.id is not null as shown, b.size_bytes, b.is_favorite, b.tags
from base_view b full join (select distinct id from ev) i on i.id = b.id""",
    },
)


def listing_of(lib):
    shown = C.with_favorites(
        C.filter_tags_all(lib.media.select("id", "size_bytes"), lib.media_tags, ["en"]), lib.favorites
    )
    return C.with_tags(shown, lib.media_tags).select(
        F.col("id").cast("string").alias("id"), "size_bytes", "is_favorite",
        F.array_distinct(F.transform("tags", lambda t: t["name"])).alias("tags"),
    )


def listed(rows):
    return rows.select(
        "id", "size_bytes", F.coalesce("is_favorite", F.lit(False)).alias("is_favorite"),
        F.array_join("tags", "|").alias("tags"),
    )


def in_batches(lib, log, base, step):
    """The state after all events, taken in three batches through a log with a snapshot."""
    log.compact_every, log.buckets = 2, 8
    log.start(base)
    parsed = durable(events(lib))
    last = parsed.agg(F.max("seq")).first()[0] or 0
    for i in range(3):
        step(parsed.where((F.col("seq") * 3 >= i * (last + 1)) & (F.col("seq") * 3 < (i + 1) * (last + 1))), i)
    return log.before()


@query("n2_apply_changes", *REPLAY)
def _(lib):
    return listed(N.apply_changes(listing_of(lib), N.item_events(events(lib)), N.View(tags=["en"])))


@query("n2_apply_in_batches", *REPLAY)
def _(lib):
    base = listing_of(lib)
    log = jobs.view_log(lib.spark, shared_folder(lib.spark, "view"), base)
    view = N.View(tags=["en"])
    return listed(in_batches(lib, log, base, lambda part, i: jobs.view_step(log, N.item_events(part), view, i)))


def session_sql(by: str, source: str, gap: str) -> str:
    part = f"partition by {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""with t as (select {head} epoch_us(ts) as t from {source}),
    f as (select *, case when t - lag(t) over ({part} order by t) <= {gap} then 0 else 1 end as o from t),
    s as (select *, sum(o) over ({part} order by t rows unbounded preceding) as run from f),
    g as (select {head} run, min(t) as lo, max(t) as hi, count(*) as n from s group by {head} run)"""


TWO_HOURS = 2 * 3600 * 1000
HALF_DAY = 12 * 3600


@query(
    "n3_debounced_refresh",
    session_sql("", "(select * from parsed where kind in ('TagLearningComplete', 'FullRefresh', 'UploadComplete'))", str(N.REFRESH_QUIET_MS * 1000))
    + f" select hi + {N.REFRESH_QUIET_MS * 1000} as due_us, n as requests from g",
    PARSED_VIEWS,
)
def _(lib):
    return W.debounced_refresh(N.refresh_requests(events(lib)), N.REFRESH_QUIET_MS)


@query(
    "n3_debounced_refresh_hours",
    session_sql("", "(select * from parsed where kind in ('TagLearningComplete', 'FullRefresh', 'UploadComplete'))", str(TWO_HOURS * 1000))
    + f" select hi + {TWO_HOURS * 1000} as due_us, n as requests from g",
    PARSED_VIEWS,
)
def _(lib):
    return W.debounced_refresh(N.refresh_requests(events(lib)), TWO_HOURS)


@query(
    "n4_attempt_limiter",
    """with a as (select user_id, event_id as seq, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
    w(user_id, seq, n, start, attempt) as (
      select user_id, seq, n, t, cast(1 as bigint) from a where n = 1
      union all select a.user_id, a.seq, a.n,
        case when (a.t - w.start) // 1000000 > 86400 then a.t else w.start end,
        case when (a.t - w.start) // 1000000 > 86400 then 1 else w.attempt + 1 end
      from w join a on a.user_id = w.user_id and a.n = w.n + 1)
    select user_id, seq, attempt, attempt <= 5 as allowed from w /*recursive*/""",
)
def _(lib):
    attempts = lib.events.select("user_id", F.col("event_id").alias("seq"), "ts")
    return W.attempt_limiter(attempts, "user_id", limit=5, window_s=86_400).select(
        "user_id", "seq", "attempt", "allowed"
    )


@query(
    "n7_inactive_sessions",
    session_sql("media_id", "changes", str(HALF_DAY * 1_000_000))
    + f" select media_id, lo as started_us, hi + {HALF_DAY * 1_000_000} as ended_us, n from g",
)
def _(lib):
    return W.inactive_sessions(lib.changes, "media_id", HALF_DAY)


# Replayed: a deletion is an event of every pair of the item, and the last event of a pair decides.
COUNTS = (
    """with said as (
      select -1 as seq, folder_id, cast(media_id as varchar) as media_id, 1 as member from folder_media
      union all select seq, json_extract_string(j, '$.data.folder_id'), id, case when kind = 'MediaAddedToFolder' then 1 else 0 end
      from event_ids where kind in ('MediaAddedToFolder', 'MediaRemovedFromFolder')),
    all_said as (
      select * from said
      union all select e.seq, p.folder_id, p.media_id, 0 from (select distinct folder_id, media_id from said) p
      join event_ids e on e.id = p.media_id and e.kind in ('MediaDeleted', 'MediaBatchDeleted')),
    final as (select *, row_number() over (partition by folder_id, media_id order by seq desc) as back from all_said)
    select folder_id, count(*) as item_count from final where back = 1 and member = 1 group by folder_id""",
    PARSED_VIEWS,
)


@query("n8_folder_counts", *COUNTS)
def _(lib):
    return N.folder_counts_after(lib.folder_media, events(lib))


@query("n8_folder_counts_in_batches", *COUNTS)
def _(lib):
    root = shared_folder(lib.spark, "members")
    log = jobs.members_log(lib.spark, root)
    base = lib.folder_media.select("folder_id", F.col("media_id").cast("string").alias("media_id"))
    rows = in_batches(lib, log, base, lambda part, i: jobs.folders_step(log, part, root, i))
    return rows.groupBy("folder_id").agg(F.count("*").alias("item_count"))
