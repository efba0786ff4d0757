"""Vector search and grouping over the embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lightbox.functions import vectors as V
from lightbox.operators import catalog as C
from lightbox.operators import similarity as I
from lightbox.plans.cells import BLOCK_ROWS
from lightbox.workload.registry import query
from lightbox.workload.scalars import CATALOG_VIEWS

GROUP_DISTANCE = 0.6
# Joins are registered a second time with blocks small enough that they take many.
SMALL_BLOCKS = 256

# Unit vectors in double precision; zero vectors have no direction.
VECTOR_VIEWS = {
    **CATALOG_VIEWS,
    "raw_vec": "select vec_id as id, label, cast(embedding as double[]) as e from embeddings",
    "unit": """
select id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) as u
from raw_vec where list_inner_product(e, e) > 0""",
    "query0": "select u as qu from unit where id = 0",
    "rep": "select min(id) as id, any_value(u) as u from unit join raw_vec using (id) group by raw_vec.e",
    "alike": f"""
select a.id as a, b.id as b, 1 - list_inner_product(a.u, b.u) as distance from rep a join rep b on a.id < b.id
where list_inner_product(a.u, b.u) >= {1 - GROUP_DISTANCE}
union all select f.first_id, f.id, 0.0 from (select id, min(id) over (partition by e) as first_id from raw_vec) f
where f.id <> f.first_id and f.first_id in (select id from unit)""",
}


def sql_query(name, sql):
    return query(name, sql, VECTOR_VIEWS)


def vectors(lib):
    return lib.embeddings.select(F.col("vec_id").alias("id"), "embedding")


def rounded(df, col="distance"):
    return df.withColumn(col, F.round(col, 6))


@sql_query(
    "d3_embeddings_scope",
    "select id, round(list_sum(u), 6) as total, round(u[1], 6) as first from unit where id in (select media_id from folder_media where folder_id = 'src0') and id in (select id from media)",
)
def _(lib):
    rows = I.embeddings_scope(C.derive_catalog(lib.media), vectors(lib), lib.folder_media, "src0")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return rows.select(
        "id", F.round(total, 6).alias("total"), F.round(F.element_at("embedding", 1), 6).alias("first")
    )


@sql_query(
    "d8_embedding_of",
    """select id, round(list_sum(u), 6) as total from unit
    where id in (select media_id from requested) and id in (select id from media)""",
)
def _(lib):
    ids = lib.requested.select(F.col("media_id").alias("id"))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return I.embedding_of(lib.media, vectors(lib), ids).select("id", F.round(total, 6).alias("total"))


@sql_query(
    "i1_l2_normalize",
    "select id, round(sqrt(list_inner_product(u, u)), 6) as norm, round(list_sum(u), 6) as total from unit",
)
def _(lib):
    u = V.l2_normalize(F.transform("embedding", lambda x: x * 3))
    total = F.aggregate("u", F.lit(0.0), lambda s, x: s + x)
    return vectors(lib).select("id", u.alias("u")).select(
        "id", F.round(F.sqrt(V.dot(F.col("u"), F.col("u"))), 6).alias("norm"), F.round(total, 6).alias("total")
    )


@sql_query(
    "i2_cosine_distance",
    """select a.id, round(list_inner_product(a.e, b.e), 6) as dot,
    round(1 - list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)), 6) as distance
    from raw_vec a join raw_vec b on b.id = a.id + 1""",
)
def _(lib):
    a = vectors(lib)
    b = a.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    pair = (F.col("embedding"), F.col("other"))
    return a.join(b, "id").select(
        "id", F.round(V.dot(*pair), 6).alias("dot"),
        F.round(V.cosine_distance(*pair), 6).alias("distance"),
    )


NEAR0 = "select id, greatest(1 - list_inner_product(u, qu), 0.0) as distance from unit, query0"


@sql_query(
    "i3_knn",
    f"""with near as ({NEAR0}),
    hits as (select * from near where distance <= 0.9 order by distance, id limit 10)
    select h.id, round(h.distance, 6) as distance, c.original_filename,
      c.id in (select media_id from favorites) as is_favorite,
      coalesce((select string_agg(tag || case when is_auto then '*' else '' end, ',' order by tag, is_auto, confidence)
        from media_tags t where t.media_id = h.id), '') as tag_names
    from hits h join media c on c.id = h.id""",
)
def _(lib):
    v = vectors(lib)
    hits = I.knn(v, I.stored_vector(v, 0), 10, 0.9)
    rows = I.with_details(
        hits, lib.media.select("id", "original_filename"), lib.favorites, lib.media_tags
    )
    return rounded(rows).select(
        "id", "distance", "original_filename", "is_favorite",
        C.tag_names(F.col("tags")).alias("tag_names"),
    )


# The same as item records.
@sql_query(
    "i4_similar_items",
    f"""with near as ({NEAR0}),
    hits as (select * from near where id <> 0 and distance <= 0.9 order by distance, id limit 10)
    select h.id, round(h.distance, 6) as distance, c.original_filename,
      c.id in (select media_id from favorites) as is_favorite,
      coalesce((select string_agg(tag || case when is_auto then '*' else '' end, ',' order by tag, is_auto, confidence)
        from media_tags t where t.media_id = h.id), '') as tag_names
    from hits h join media c on c.id = h.id""",
)
def _(lib):
    rows = I.with_details(
        I.knn_by_id(vectors(lib), 0, 10, 0.9), lib.media.select("id", "original_filename"), lib.favorites, lib.media_tags
    )
    return rounded(rows).select(
        "id", "distance", "original_filename", "is_favorite", C.tag_names(F.col("tags")).alias("tag_names")
    )


@sql_query(
    "i4_knn_by_id",
    f"""with near as ({NEAR0}) select id, round(distance, 6) as distance from near
    where id <> 0 and distance <= 0.9 order by near.distance, id limit 10""",
)
def _(lib):
    return rounded(I.knn_by_id(vectors(lib), 0, 10, 0.9))


@sql_query(
    "f4_top_k_distance",
    f"with near as ({NEAR0}) select id, round(distance, 6) as distance from near order by near.distance, id limit 25",
)
def _(lib):
    v = vectors(lib)
    scored = v.select("id", V.distance_to(F.col("embedding"), I.stored_vector(v, 0)).alias("distance"))
    return rounded(I.top_k_distance(scored, 25))


for _name, _rows in (("i5_knn_join", BLOCK_ROWS), ("i5_knn_join_blocks", SMALL_BLOCKS)):

    @sql_query(
        _name,
        """select query_id, id, round(distance, 6) as distance, rank from (
          select a.id as query_id, b.id, 1 - list_inner_product(a.u, b.u) as distance,
            row_number() over (partition by a.id order by 1 - list_inner_product(a.u, b.u), b.id) as rank
          from unit a join unit b on a.id <> b.id) where rank <= 5""",
    )
    def _(lib, rows=_rows):
        out = rounded(I.knn_join(vectors(lib), vectors(lib), 5, block_rows=rows))
        return out.withColumn("rank", F.col("rank").cast("long"))


@sql_query(
    "i6_nearest_excluding",
    f"""with near as ({NEAR0}) select id, round(distance, 6) as distance from near
    where id not in (select media_id from media_tags where not is_auto) order by near.distance, id limit 20""",
)
def _(lib):
    v = vectors(lib)
    tagged = lib.media_tags.where("not is_auto").select(F.col("media_id").alias("id"))
    return rounded(I.nearest_excluding(v, I.stored_vector(v, 0), 20, tagged))


CENTER_VIEWS = {
    **VECTOR_VIEWS,
    "mean_pos": """
select label, pos, avg(x) as m from (select label, unnest(u) as x, generate_subscripts(u, 1) as pos from unit) group by label, pos""",
    "center": """
select label, list(m / norm order by pos) as c from
(select label, pos, m, sqrt(sum(m * m) over (partition by label)) as norm from mean_pos) group by label""",
    "spread": """
select u.id, u.label, greatest(1 - list_inner_product(u.u, c.c), 0.0) as distance from unit u join center c on c.label = u.label""",
}


@query(
    "i7_centroid",
    "select label, round(list_sum(c), 6) as total, round(c[1], 6) as first from center",
    CENTER_VIEWS,
)
def _(lib):
    unit = lib.embeddings.select("label", V.l2_normalize(F.col("embedding")).alias("embedding"))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return I.centroids(unit, "label").select(
        "label", F.round(total, 6).alias("total"), F.round(F.element_at("embedding", 1), 6).alias("first")
    )


# One row per item, over all items, copies included.
for _name, _rows in (("i8_similar_pairs", BLOCK_ROWS), ("i8_similar_pairs_blocks", SMALL_BLOCKS)):

    @sql_query(
        _name,
        f"""select a.id, count(*) as neighbours, round(min(greatest(1 - list_inner_product(a.u, b.u), 0.0)), 6) as nearest
        from unit a join unit b on a.id <> b.id where list_inner_product(a.u, b.u) >= {1 - GROUP_DISTANCE} group by a.id""",
    )
    def _(lib, rows=_rows):
        return rounded(I.similar_items(vectors(lib), GROUP_DISTANCE, rows), "nearest")


@sql_query(
    "i9_pair_guard",
    f"""select (select count(*) from embeddings) as items, count(*) as pairs from unit a join unit b on a.id < b.id
    where list_inner_product(a.u, b.u) >= {1 - GROUP_DISTANCE}""",
)
def _(lib):
    items, pairs = I.pair_guard(vectors(lib), GROUP_DISTANCE)
    return lib.spark.range(1).select(F.lit(items).cast("long").alias("items"), F.lit(pairs).cast("long").alias("pairs"))


REACH = """
reach(id, other) as (
  select a, b from alike union select b, a from alike
  union select r.id, case when s.a = r.other then s.b else s.a end
  from reach r join alike s on s.a = r.other or s.b = r.other)"""


@sql_query(
    "i10_connected_components",
    f"""with {REACH} select id, least(id, min(other)) as component from reach group by id /*recursive*/""",
)
def _(lib):
    # Links reach the components as forests of the tasks that find them: pairs grow with the square of the items.
    return I.similarity_components(vectors(lib), GROUP_DISTANCE)


for _name, _rows in (("i11_group_similar", BLOCK_ROWS), ("i11_group_similar_blocks", SMALL_BLOCKS)):

    @query(
        _name,
        f"""with {REACH},
        member as (select id, least(id, min(other)) as component from reach group by id),
        head as (select component, row_number() over (order by c.original_date desc, component) - 1 as group_id
          from (select distinct component from member) join catalog c on c.id = component)
        select group_id, id from member join head using (component) /*recursive*/""",
        {**VECTOR_VIEWS, "raw_vec": VECTOR_VIEWS["raw_vec"] + " where vec_id in (select id from media)"},
    )
    def _(lib, rows=_rows):
        scope = I.embeddings_scope(C.derive_catalog(lib.media), vectors(lib))
        return I.group_similar(scope, GROUP_DISTANCE, rows)


@query(
    "i12_outlier_filter",
    """select id, label, round(distance, 6) as distance from spread join
    (select label, count(*) as n, avg(distance) as m from spread group by label) using (label)
    where not (n > 5 and distance > 3 * m)""",
    CENTER_VIEWS,
)
def _(lib):
    unit = lib.embeddings.select(
        F.col("vec_id").alias("id"), "label", V.l2_normalize(F.col("embedding")).alias("embedding")
    )
    return rounded(I.outlier_filter(unit, "label")).select("id", "label", "distance")
