"""Vector search and similarity grouping.

Vector tables hold (id, embedding). Zero vectors have no direction: they match
nothing and never join a group.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lightbox.functions import vectors as V
from lightbox.operators import catalog as C
from lightbox.plans.cells import BLOCK_ROWS, pairs_within
from lightbox.plans.components import connected_components
from lightbox.plans.nearest import nearest
from lightbox.plans.ordered import positions
from lightbox.session import durable

# Fixed value: the default distance of grouping.
DEFAULT_GROUP_DISTANCE = 0.2


def embeddings_scope(
    media: DataFrame, vectors: DataFrame, folder_media: DataFrame | None = None, folder_id=None
) -> DataFrame:
    """Items that have a vector, scaled to unit length; optionally of one folder."""
    rows = media.select("id", "original_date")
    if folder_id is not None:
        rows = C.filter_folder(rows, folder_media, folder_id)
    return rows.join(vectors.select("id", "embedding"), "id").withColumn(
        "embedding", V.l2_normalize(F.col("embedding"))
    )


def embedding_of(media: DataFrame, vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Unit vectors of the wanted ids; nothing where item or vector is absent."""
    wanted = ids.select("id").distinct().join(media.select("id"), "id", "left_semi")
    return vectors.select("id", "embedding").join(wanted, "id", "left_semi").withColumn(
        "embedding", V.l2_normalize(F.col("embedding"))
    )


def top_k_distance(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy("distance", "id").limit(k)


def knn(vectors: DataFrame, query, k: int, max_distance: float | None = None) -> DataFrame:
    """(id, distance) of the k nearest vectors within ``max_distance``."""
    scored = vectors.select("id", V.distance_to(F.col("embedding"), query).alias("distance"))
    scored = scored.where(F.col("distance").isNotNull())
    if max_distance is not None:
        scored = scored.where(F.col("distance") <= max_distance)
    return top_k_distance(scored, k)


def stored_vector(vectors: DataFrame, item_id) -> np.ndarray:
    """The vector of one item; an error when there is none."""
    row = vectors.where(F.col("id") == item_id).select("embedding").first()
    if row is None or row[0] is None:
        raise LookupError(f"no vector for {item_id}")
    return np.asarray(row[0], np.float64)


def knn_by_id(vectors: DataFrame, item_id, k: int, max_distance: float | None = None) -> DataFrame:
    """The k nearest of a stored item, itself left out."""
    others = vectors.where(F.col("id") != item_id)
    return knn(others, stored_vector(vectors, item_id), k, max_distance)


def nearest_excluding(vectors: DataFrame, query, k: int, excluded: DataFrame) -> DataFrame:
    """The k nearest outside a set of ids."""
    return knn(vectors.join(excluded.select("id"), "id", "left_anti"), query, k)


def with_details(
    found: DataFrame, media: DataFrame, favorites: DataFrame, media_tags: DataFrame
) -> DataFrame:
    """Item records, favorite mark and tags for the few rows a search returned."""
    hits = durable(found)
    rows = media.join(F.broadcast(hits), "id")
    return C.with_page_details(rows, favorites, media_tags)


def knn_join(
    queries: DataFrame, corpus: DataFrame, k: int, max_distance: float | None = None,
    skip_same_id: bool = True, block_rows: int = BLOCK_ROWS, skip: str | None = None,
) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest corpus vectors of every query.

    Candidates come already cut to k per query and block; the rank filter is a
    window limit, so partial lists are cut again before they are shuffled.
    """
    found = nearest(queries, corpus, k, skip_same_id, block_rows, skip)
    if max_distance is not None:
        found = found.where(F.col("distance") <= max_distance)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Unit-length mean vector of every group, combined map-side."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding")))
    return vectors.groupBy(group).agg(mean.alias("_m"), F.count("*").alias("n")).select(
        group, "n", V.l2_normalize(vector_to_array("_m")).alias("embedding")
    )


def distances_to_centroid(vectors: DataFrame, centers: DataFrame, group: str) -> DataFrame:
    c = centers.select(group, F.col("embedding").alias("_c"))
    return vectors.join(c, group).withColumn(
        "distance",
        F.greatest(F.lit(1.0) - V.dot(F.col("embedding"), F.col("_c")), F.lit(0.0)),
    ).drop("_c")


def outlier_filter(vectors: DataFrame, group: str) -> DataFrame:
    """Per group of more than five: drop vectors farther than three mean distances.

    Fewer than a third of non-negative numbers exceed three times their mean, so
    at least four vectors always remain and no removal order is needed.
    """
    scored = distances_to_centroid(vectors, centroids(vectors, group), group)
    stats = scored.groupBy(group).agg(F.count("*").alias("_n"), F.avg("distance").alias("_avg"))
    far = (F.col("_n") > 5) & (F.col("distance") > 3 * F.col("_avg"))
    return scored.join(stats, group).where(~far).drop("_n", "_avg")


def collapse_copies(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one vector per distinct value, edges (u, v) from each copy to its first id).

    A set of copies would be compared with itself pair by pair; here it is one
    row and a star, which holds the same information.
    """
    keyed = durable(
        vectors.where(~V.is_zero(F.col("embedding"))).select(
            "id", V.fingerprint(F.col("embedding")).alias("_key")
        )
    )
    first = keyed.groupBy("_key").agg(F.min("id").alias("_first"), F.count("*").alias("_n"))
    copies = keyed.join(first.where(F.col("_n") > 1), "_key").where(
        F.col("id") != F.col("_first")
    ).select(F.col("id").alias("u"), F.col("_first").alias("v"))
    if copies.isEmpty():
        return vectors, copies
    return vectors.join(copies.select(F.col("u").alias("id")), "id", "left_anti"), copies


def similar_pairs(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, distance), a < b, of distinct vectors within ``threshold``, plus one
    row at distance zero from each copy to the first item with its vector."""
    distinct, copies = collapse_copies(vectors)
    stars = copies.select(
        F.col("v").cast("long").alias("a"), F.col("u").cast("long").alias("b"), F.lit(0.0).alias("distance")
    )
    return pairs_within(distinct, threshold, "pairs", block_rows).unionByName(stars)


def weighted_distinct(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct vectors with ``weight``, (id, rep) of every directed vector)."""
    directed = vectors.where(F.col("embedding").isNotNull() & ~V.is_zero(F.col("embedding")))
    keyed = durable(directed.select("id", V.fingerprint(F.col("embedding")).alias("_key")))
    first = durable(keyed.groupBy("_key").agg(F.min("id").alias("rep"), F.count("*").alias("weight")))
    members = keyed.join(first, "_key").select("id", "rep")
    # Written, since it is counted, sampled and compared.
    distinct = durable(directed.join(first.select(F.col("rep").alias("id"), "weight"), "id").select("id", "embedding", "weight"))
    return distinct, members


def similar_items(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, neighbours, nearest): how many other items lie within ``threshold``, copies
    included, and the distance of the nearest; items without neighbours are left out.

    One row per item, however crowded it is: pairs are counted where they are found.
    """
    distinct, members = weighted_distinct(vectors)
    near = pairs_within(distinct, threshold, "degree", block_rows).groupBy("id").agg(
        F.sum("n").alias("n"), F.min("nearest").alias("nearest")
    )
    reps = distinct.select(F.col("id").cast("long").alias("rep"), "weight").join(
        near.withColumnRenamed("id", "rep"), "rep", "left"
    )
    return members.join(reps, "rep").select(
        "id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("neighbours"),
        F.when(F.col("weight") > 1, 0.0).otherwise(F.col("nearest")).alias("nearest"),
    ).where("neighbours > 0")


def pair_guard(
    vectors: DataFrame, threshold: float, max_items: int | None = None,
    max_pairs: int | None = None, block_rows: int = BLOCK_ROWS,
) -> tuple[int, int]:
    """(items, pairs), or an error when either passes a limit that the caller sets;
    pairs are counted where they are found and never written."""
    items = vectors.count()
    if max_items is not None and items > max_items:
        raise ValueError(f"too many items to group: {items} (max {max_items})")
    distinct, _ = weighted_distinct(vectors)
    copies = distinct.agg(F.sum(F.expr("weight * (weight - 1) div 2"))).first()[0] or 0
    found = copies + (pairs_within(distinct, threshold, "count", block_rows).agg(F.sum("n")).first()[0] or 0)
    if max_pairs is not None and found > max_pairs:
        raise ValueError(f"too many similar pairs (>{max_pairs}): raise the similarity")
    return items, found


def similarity_components(
    vectors: DataFrame, threshold: float = DEFAULT_GROUP_DISTANCE, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(id, component) of items linked by chains of similar pairs; component is the least id."""
    distinct, copies = collapse_copies(vectors)
    edges = pairs_within(distinct, threshold, "forest", block_rows)
    return connected_components(edges.unionByName(copies.select(
        F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")
    )))


def group_similar(
    scope: DataFrame, threshold: float = DEFAULT_GROUP_DISTANCE, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(group_id, id): groups of at least two, newest first item first, numbered from 0.

    ``scope`` holds (id, original_date, embedding). The first item of a group is
    its least id; equal dates are settled by it.
    """
    # The scope is usually a join; the vectors are scanned several times below.
    members = durable(
        similarity_components(durable(scope.select("id", "embedding")), threshold, block_rows)
    )
    heads = scope.select(F.col("id").alias("component"), "original_date").join(
        members.select("component").distinct(), "component"
    )
    numbered = positions(
        heads, [], [F.col("original_date").desc(), F.col("component")], "_n"
    ).select("component", (F.col("_n") - 1).alias("group_id"))
    return members.join(numbered, "component").select("group_id", "id")
