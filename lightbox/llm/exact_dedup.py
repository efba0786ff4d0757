"""Exact dedup by a content sort.

Sampled splitters range-partition the normalised texts, by leading characters and
a hash of the whole, together with the order in which copies are preferred, so a
text with any number of copies spreads over as many tasks as it needs. Each task
sorts its range externally; equal texts are then neighbours and are found by
comparing each text with the one before it. A group that runs over a border of
ranges is stitched from one row per range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lightbox.session import durable


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


# Characters of a text that order it first; hashes of the whole, then the whole, settle equal beginnings.
LEADING = 32


def _sorted_ranges(rows: DataFrame, norm: Column, carry: str, ranges: int) -> DataFrame:
    """(part, norm, ``carry``) in global order of (text, most characters, least id).

    Texts are ordered by their leading characters, then by two hashes of the whole, then by the whole, so
    equal texts are neighbours whatever the hashes say. Splitters sampled on the driver
    leave the whole out, so they stay small however long texts are.
    """
    keys = {"lead": F.substring(norm, 1, LEADING), "h1": F.xxhash64(norm), "h2": F.xxhash64(F.lit(1), norm)}
    preference = [F.desc("n_chars"), F.asc_nulls_last("id")]
    return (
        rows.withColumns(keys)
        .repartitionByRange(ranges, "lead", "h1", "h2", *preference)
        .withColumn("norm", norm)
        .sortWithinPartitions("lead", "h1", "h2", "norm", *preference)
        .select(F.spark_partition_id().alias("part"), "norm", carry)
    )


def _opens(norm: pa.Array, previous: str | None) -> list[bool]:
    """Which rows differ from the row before them."""
    if len(norm) == 1:
        return [norm[0].as_py() != previous]
    return [norm[0].as_py() != previous, *pc.not_equal(norm[1:], norm[:-1]).to_pylist()]


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One line per row of the range, and two edge lines."""
    ids, starts, digests = [], [], []
    previous = first = None
    part = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        norm = batch.column("norm")
        part = batch.column("part")[0].as_py()
        if previous is None:
            first = norm[0].as_py()
        new = _opens(norm, previous)
        previous = norm[batch.num_rows - 1].as_py()
        ids += batch.column("id").to_pylist()
        for i, opens in enumerate(new):
            if opens:
                starts.append(len(ids) - batch.num_rows + i)
                digests.append(hashlib.sha256(norm[i].as_buffer() or b"").hexdigest())
    if previous is None:
        return
    ends = [*starts[1:], len(ids)]
    group = [g for g, (a, b) in enumerate(zip(starts, ends)) for _ in range(a, b)]
    n = len(ids)
    size = 20_000
    for a in range(0, n, size):
        g = group[a : a + size]
        yield _lines(
            part, id=ids[a : a + size], group=g, leader=[ids[starts[x]] for x in g],
            members=[ends[x] - starts[x] for x in g], opens=[starts[x] == a + i for i, x in enumerate(g)],
            text_sha256=[digests[x] for x in g],
        )
    last = len(starts) - 1
    yield _lines(
        part, id=[None, None], group=[0, last], leader=[ids[0], ids[starts[last]]],
        members=[ends[0], n - starts[last]], edge=["first", "last"], edge_norm=[first, previous],
    )


def _lines(part: int, **columns) -> pa.RecordBatch:
    n = len(columns["id"])
    kinds = {
        "part": pa.int32(), "id": pa.int64(), "group": pa.int64(), "leader": pa.int64(), "members": pa.int64(),
        "opens": pa.bool_(), "text_sha256": pa.string(), "edge": pa.string(), "edge_norm": pa.string(),
    }
    return pa.record_batch(
        {k: pa.array([part] * n if k == "part" else columns.get(k, [None] * n), t) for k, t in kinds.items()}
    )


LINES = (
    "part int, id long, group long, leader long, members long, opens boolean, text_sha256 string, "
    "edge string, edge_norm string"
)


def _stitched(edges: DataFrame) -> DataFrame:
    """Groups that run over a border: (part, group, keep_id, group_size, continues).

    Adjacent edge texts are compared in full, in a join by range number. The
    chains themselves are followed over one narrow row per range.
    """
    first = edges.where("edge = 'first'")
    last = edges.where("edge = 'last'")
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    ranges = first.select("part", F.lag("part").over(order).alias("before"))
    heads = first.join(ranges, "part").select("part", "before", "edge_norm", F.col("members").alias("n_head"))
    tails = last.select(
        F.col("part").alias("before"), F.col("edge_norm").alias("before_norm"),
    )
    joined = heads.join(tails, "before", "left").select(
        "part", "n_head", F.coalesce(F.col("edge_norm") == F.col("before_norm"), F.lit(False)).alias("continues")
    )
    whole = joined.join(
        last.select("part", "group", "leader", F.col("members").alias("n_tail")), "part"
    )
    opens = ~F.col("continues") | (F.col("group") > 0)
    root = F.last(F.when(opens, F.col("part")), ignorenulls=True)
    whole = whole.withColumn("own_root", root.over(order)).withColumn(
        "head_root", root.over(order.rowsBetween(Window.unboundedPreceding, -1))
    )
    tail_pieces = whole.where(opens).select(
        F.col("part").alias("root"), "part", "group", F.col("n_tail").alias("n"), F.lit(False).alias("continues")
    )
    head_pieces = whole.where("continues").select(
        F.col("head_root").alias("root"), "part", F.lit(0).cast("long").alias("group"),
        F.col("n_head").alias("n"), F.lit(True).alias("continues"),
    )
    pieces = tail_pieces.unionByName(head_pieces)
    totals = pieces.groupBy("root").agg(F.sum("n").alias("group_size"), F.count("*").alias("pieces")).where("pieces > 1")
    leaders = last.select(F.col("part").alias("root"), F.col("leader").alias("keep_id"))
    return (
        pieces.join(totals, "root").join(leaders, "root")
        .select("part", "group", F.col("keep_id"), "group_size", "continues")
    )


def _n_chars(text: Column) -> Column:
    return F.char_length(F.coalesce(text, F.lit("")))


def copy_groups(docs: DataFrame, text: str = "text", id: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """The copy group of every row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space is deleted. Of equal
    texts the one with most code points stays, then the smallest id; null ids
    come last. Exactly one row of a group is kept, also where ids repeat. A null
    text counts as empty. An empty table gives an empty result; other columns
    are not read.
    """
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(id).cast("long").alias("id"), _n_chars(F.col(text)).alias("n_chars"),
        normalised(F.col(text)).alias("norm"),
    )
    placed = _sorted_ranges(rows, F.col("norm"), "id", ranges)
    lines = durable(placed.mapInArrow(_decide, LINES))
    fixes = _stitched(lines.where("edge is not null")).withColumnRenamed("keep_id", "chain_id").withColumnRenamed(
        "group_size", "chain_size"
    )
    joined = lines.where("edge is null").join(fixes, ["part", "group"], "left")
    stitched = F.col("chain_size").isNotNull()
    return joined.select(
        F.col("id").alias("doc_id"),
        F.when(stitched, F.col("chain_id")).otherwise(F.col("leader")).alias("keep_id"),
        F.when(stitched, F.col("chain_size")).otherwise(F.col("members")).alias("group_size"),
        (F.col("opens") & ~F.coalesce(F.col("continues"), F.lit(False))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, text: str = "text", id: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`copy_groups` keeps, whole and with all their columns.

    Whatever the columns are called, nothing clashes: rows travel as one struct.
    """
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id).cast("long").alias("id"), _n_chars(F.col(text)).alias("n_chars"),
    )
    placed = _sorted_ranges(rows, normalised(F.col("row").getField(text)), "row", ranges)

    def leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous = first = None
        part = groups = 0
        row_type = None
        for batch in batches:
            if not batch.num_rows:
                continue
            norm, row = batch.column("norm"), batch.column("row")
            row_type = row.type
            part = batch.column("part")[0].as_py()
            opening = previous is None
            if opening:
                first = norm[0].as_py()
            new = _opens(norm, previous)
            previous = norm[batch.num_rows - 1].as_py()
            groups += sum(new)
            kept = row.filter(pa.array(new))
            n = len(kept)
            yield pa.record_batch({
                "row": kept, "part": pa.array([part] * n, pa.int32()),
                "head": pa.array([opening and i == 0 for i in range(n)], pa.bool_()),
                "edge": pa.nulls(n, pa.string()), "edge_norm": pa.nulls(n, pa.string()),
                "group": pa.nulls(n, pa.int64()),
            })
        if previous is not None:
            yield pa.record_batch({
                "row": pa.nulls(2, row_type), "part": pa.array([part] * 2, pa.int32()),
                "head": pa.array([False, False]), "edge": pa.array(["first", "last"]),
                "edge_norm": pa.array([first, previous], pa.string()),
                "group": pa.array([0, groups - 1], pa.int64()),
            })

    schema = T.StructType([
        T.StructField("row", placed.schema["row"].dataType), T.StructField("part", T.IntegerType()),
        T.StructField("head", T.BooleanType()), T.StructField("edge", T.StringType()),
        T.StructField("edge_norm", T.StringType()), T.StructField("group", T.LongType()),
    ])
    out = durable(placed.mapInArrow(leaders, schema))
    edges = out.where("edge is not null").select(
        "part", "edge", "edge_norm", "group", F.lit(None).cast("long").alias("leader"), F.lit(1).cast("long").alias("members")
    )
    # At most one row per range, so the rows themselves need not move again.
    again = F.broadcast(_stitched(edges).where("continues").select("part", F.lit(True).alias("head")))
    return out.where("edge is null").join(again, ["part", "head"], "left_anti").select("row.*")
