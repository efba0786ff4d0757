"""Export plans of folders and requested lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lightbox.operators import export as M
from lightbox.operators import catalog as C
from lightbox.workload.registry import query

CAP = 60_000
STAMP = "20240101_000000"

# The sequential rule as a recursion over item positions of every plan.
PACK_VIEWS = {
    "plan_item": """
select folder_id as plan, id, size_bytes, row_number() over (partition by folder_id order by id) as n
from folder_media f join media m on m.id = f.media_id""",
}
PACKED = f"""
packed(plan, n, id, size_bytes, filled, part) as (
  select plan, n, id, size_bytes, size_bytes, cast(1 as bigint) from plan_item where n = 1
  union all select i.plan, i.n, i.id, i.size_bytes,
    case when p.filled + i.size_bytes > {CAP} then i.size_bytes else p.filled + i.size_bytes end,
    case when p.filled + i.size_bytes > {CAP} then p.part + 1 else p.part end
  from packed p join plan_item i on i.plan = p.plan and i.n = p.n + 1)"""


def folder_list(lib, *columns):
    return C.folder_items(lib.media.select("id", *columns), lib.folder_media).select(
        F.col("folder_id").alias("plan"), F.col("id").alias("pos"), "id", *columns
    )


@query(
    "m1_unique_entry_names",
    r"""with named as (select folder_id as plan, id, trim(regexp_replace(original_filename, '[\x00-\x1f\x7f/\\"'']', '', 'g')) as base
      from folder_media f join media m on m.id = f.media_id),
    nth as (select *, row_number() over (partition by plan, base order by id) - 1 as k from named)
    select plan, id, case when k = 0 then base
      else regexp_replace(base, '\.[^.]*$', '') || '_' || cast(k as varchar) || regexp_extract(base, '\.[^.]*$') end as entry_name
    from nth""",
)
def _(lib):
    return M.unique_entry_names(folder_list(lib, "original_filename")).select("plan", "id", "entry_name")


@query(
    "m2_pack_parts",
    f"with {PACKED} select plan, id, part from packed /*recursive*/",
    PACK_VIEWS,
)
def _(lib):
    return M.pack_parts(folder_list(lib, "size_bytes"), CAP).select("plan", "id", "part")


PLAN_SQL = f"""with {PACKED},
    parts as (select plan, part, cast(sum(size_bytes) as bigint) as size_estimate, count(*) as items from packed group by plan, part),
    top as (select plan, max(part) as parts from parts group by plan)
    select p.plan, p.part, p.plan || '-' || cast(p.part as varchar) as part_id,
      %s || case when t.parts = 1 then '' else '_part' || cast(p.part as varchar) end || '_{STAMP}.zip' as filename,
      size_estimate, items
    from parts p join top t on t.plan = p.plan %s /*recursive*/"""


@query(
    "m4_folder_export_plans",
    PLAN_SQL % ("replace(f.name, ' ', '_')", "join folders f on f.folder_id = p.plan"),
    PACK_VIEWS,
)
def _(lib):
    return M.folder_export_plans(lib.folders, lib.folder_media, lib.media, STAMP, CAP)[0]


# Folders left without an item once only large scans are kept.
@query(
    "m4_empty_folders",
    """select folder_id, name from folders where folder_id not in
    (select f.folder_id from folder_media f join media m on m.id = f.media_id where m.size_bytes > 2500 and m.id % 6 = 5)""",
)
def _(lib):
    kept = lib.media.where("size_bytes > 2500 and id % 6 = 5")
    return M.empty_folders(lib.folders, lib.folder_media, kept).select("folder_id", "name")


@query(
    "m3_export_plan",
    PLAN_SQL % ("'export_' || cast((select count(*) from plan_item) as varchar)", ""),
    {
        "plan_item": """
select 'batch' as plan, id, size_bytes, row_number() over (order by pos) as n from
(select media_id as id, min(pos) as pos from requested group by media_id) r join media m using (id)"""
    },
)
def _(lib):
    return M.batch_export_plan(lib.requested, lib.media, STAMP, cap=CAP)[0]


@query(
    "m5_expire_plans",
    """select event_id as plan, strftime(ts + interval 1 hour, '%Y-%m-%d %H:%M:%S') as expires_at from events
    where ts + interval 1 hour > (select max(ts) - interval 12 hour from events)""",
)
def _(lib):
    plans = M.with_expiry(lib.events.select(F.col("event_id").alias("plan"), F.col("ts").alias("created_at")))
    now = lib.events.agg(F.max("ts") - F.expr("interval 12 hours")).scalar()
    return M.expire_plans(plans, now).select(
        "plan", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at")
    )
