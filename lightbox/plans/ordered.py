"""Order-dependent work split over many tasks.

A window over one hot group sorts that group in a single task. Here the rows are
range-partitioned by (group, order) instead, so a hot group spreads over as many
blocks as it needs; a window runs inside each block and small per-block totals
carry the state from block to block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lightbox.session import durable

# Rows one task folds on its own; longer sequences are cut into blocks of this size.
FOLD_ROWS = 200_000


def _join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet null keys; the key columns are those of ``left``."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(other, condition, how).drop(*[f"_r_{c}" for c in on])


def running(
    rows: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column | None = None
) -> DataFrame:
    """Add ``position`` (1-based in its group), ``sequence`` (1-based over all
    groups) and, with ``value``, the inclusive running ``total`` of the group.

    ``order`` must be unique within a group. Range boundaries are sampled, so
    the split is made durable before anything is counted on it.
    """
    keys = [F.col(b) for b in by]
    valued = rows.withColumn("_value", F.lit(0) if value is None else value)
    blocks = durable(
        valued.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id())
    )
    inside = Window.partitionBy("_block", *by).orderBy(*order)
    local = blocks.withColumn("_row", F.row_number().over(inside)).withColumn(
        "_sum", F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    parts = blocks.groupBy("_block", *by).agg(
        F.count("*").alias("_n"), F.sum("_value").alias("_v")
    )
    # One row per (block, group): a group has at most as many rows as there are blocks.
    before = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = before.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    group_offset = parts.select(
        "_block", *by, "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_v0"),
    )
    # Groups are contiguous in the range order, so inside a block they follow each other.
    in_block = Window.partitionBy("_block").orderBy(*(keys or [F.lit(0)])).rowsBetween(
        Window.unboundedPreceding, -1
    )
    all_blocks = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    block_offset = parts.groupBy("_block").agg(F.sum("_n").alias("_bn")).select(
        "_block", F.coalesce(F.sum("_bn").over(all_blocks), F.lit(0)).alias("_b0")
    )
    offsets = (
        group_offset.withColumn("_g0", F.coalesce(F.sum("_n").over(in_block), F.lit(0)))
        .join(block_offset, "_block").drop("_n")
    )
    out = _join_null_safe(local, offsets, ["_block", *by]).withColumns(
        {
            "position": (F.col("_n0") + F.col("_row")).cast("long"),
            "sequence": (F.col("_b0") + F.col("_g0") + F.col("_row")).cast("long"),
            "total": F.col("_v0") + F.col("_sum"),
        }
    )
    keep = [*rows.columns, "position", "sequence"] + ([] if value is None else ["total"])
    return out.select(*keep)


def positions(
    rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "position",
    fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """Row numbers in ``order`` inside each group.

    Group sizes are checked first: a plain window serves while every group fits
    one task, :func:`running` splits the groups otherwise.
    """
    largest = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= fold_rows:
        window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        return rows.withColumn(name, F.row_number().over(window.orderBy(*order)).cast("long"))
    return running(rows, by, order).drop("sequence").withColumnRenamed("position", name)


def ranked_slice(
    rows: DataFrame, by: Sequence[str], order: Sequence[Column], first: int, last: int, name: str = "rank"
) -> DataFrame:
    """Rows whose 1-based rank in their group lies above ``first`` and not above ``last``, with that rank.

    The rows are range-partitioned by (group, order) and counted block by block. Counts tell which
    blocks of a group the slice falls into, and only those are ranked: a task
    sorts one block however deep the slice lies and however large its group is. ``order`` must be
    unique within a group.
    """
    keys = [F.col(b) for b in by]
    blocks = durable(rows.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id()))
    # One row per (block, group): a group has at most as many rows as there are blocks.
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counted = blocks.groupBy("_block", *by).agg(F.count("*").alias("_n")).withColumn(
        "_n0", F.coalesce(F.sum("_n").over(before), F.lit(0))
    )
    met = durable(counted.where((F.col("_n0") < last) & (F.col("_n0") + F.col("_n") > first)).drop("_n"))
    inside = Window.partitionBy("_block", *by).orderBy(*order)
    ranked = _join_null_safe(blocks, met, ["_block", *by]).withColumn(
        name, (F.col("_n0") + F.row_number().over(inside)).cast("long")
    )
    return ranked.where((F.col(name) > first) & (F.col(name) <= last)).select(*rows.columns, name)


def _next_starts(q: np.ndarray, p: np.ndarray, span: int) -> np.ndarray:
    """Index of the row that opens the segment after one opened at each row."""
    return np.maximum(np.searchsorted(p, q + span, side="right"), np.arange(1, len(q) + 1))


def _follow(nxt: np.ndarray, start: int, end: int) -> list[int]:
    """Rows on the chain from ``start`` that lie before ``end``."""
    chain, hop = [], nxt.tolist()
    while start < end:
        chain.append(start)
        start = hop[start]
    return chain


def greedy_segments(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], span: int,
    *, size: str | None = None, at: str | None = None, fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """Cut each ordered group into segments anchored at their first row.

    With ``size`` a segment takes rows while their sum stays within ``span``
    (an oversized row stands alone); with ``at`` it takes rows at most ``span``
    after its first. Adds ``segment`` (1-based), ``rank`` (1-based inside the
    segment). Groups of up to ``fold_rows`` rows are folded whole, many to a
    task; larger ones go through :func:`_long_segments`.
    """
    if (size is None) == (at is None):
        raise ValueError("give either size or at")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    stats = sizes.agg(F.max("_n").alias("largest"), F.sum("_n").alias("all")).first()
    if not stats["all"]:
        return rows.withColumns({"segment": F.lit(0).cast("long"), "rank": F.lit(0).cast("long")})
    if stats["largest"] <= fold_rows:
        return _short_segments(rows, by, order, span, size, at, stats["all"], fold_rows)
    long_keys = sizes.where(F.col("_n") > fold_rows).select(*by)
    short = _join_null_safe(rows, long_keys, by, "left_anti")
    long = _join_null_safe(rows, long_keys, by, "left_semi")
    return _short_segments(short, by, order, span, size, at, stats["all"], fold_rows).unionByName(
        _long_segments(long, by, order, span, size, at, fold_rows)
    )


def _short_segments(rows, by, order, span, size, at, total_rows, fold_rows) -> DataFrame:
    by, order = list(by), list(order)
    buckets = max(rows.sparkSession.sparkContext.defaultParallelism, total_rows // fold_rows + 1)
    schema = T.StructType(
        [*rows.schema.fields, T.StructField("segment", T.LongType()), T.StructField("rank", T.LongType())]
    )

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="_bucket").sort_values(by + order, kind="stable").reset_index(drop=True)
        group = pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(pdf)]])
        segment = np.empty(len(pdf), np.int64)
        rank = np.empty(len(pdf), np.int64)
        amount = pdf[size or at].to_numpy(np.int64)
        for lo, hi in zip(edges[:-1], edges[1:]):
            part = amount[lo:hi]
            p = np.cumsum(part) if size else part
            q = p - part if size else part
            starts = np.asarray(_follow(_next_starts(q, p, span), 0, hi - lo))
            mark = np.zeros(hi - lo, np.int64)
            mark[starts] = 1
            segment[lo:hi] = np.cumsum(mark)
            rank[lo:hi] = np.arange(hi - lo) - starts[segment[lo:hi] - 1] + 1
        return pdf.assign(segment=segment, rank=rank)

    bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)))
    return bucketed.groupBy("_bucket").applyInPandas(fold, schema)


def _long_segments(rows, by, order, span, size, at, fold_rows) -> DataFrame:
    """Segments of groups too long for one task.

    The row that opens the following segment is known for every row from a
    running count, so segments form chains of pointers. Blocks of ``fold_rows``
    consecutive rows are walked independently; pointer doubling over the rows
    where a chain can cross into another block tells which crossings are real.
    """
    order_cols = [F.col(c) for c in order]
    value = F.col(size) if size else F.lit(0)
    placed = running(rows, by, order_cols, value)
    p = F.col("total") if size else F.col(at)
    q = F.col("total") - F.col(size) if size else F.col(at)
    placed = durable(placed.withColumns({"_q": q.cast("long"), "_p": p.cast("long")}).drop("total"))

    # Rows ending at or before q + span, counted for every row in one ordered pass.
    ends = placed.select(*by, F.col("_p").alias("_x"), F.lit(0).alias("_kind"), "sequence", "position")
    asks = placed.select(
        *by, (F.col("_q") + F.lit(span)).alias("_x"), F.lit(1).alias("_kind"), "sequence", "position"
    )
    counted = running(
        ends.unionByName(asks).withColumnRenamed("position", "_pos").withColumnRenamed("sequence", "_seq"),
        by, [F.col("_x"), F.col("_kind"), F.col("_seq")], F.when(F.col("_kind") == 0, 1).otherwise(0),
    ).where(F.col("_kind") == 1)
    hop = F.greatest(F.col("total") - F.col("_pos"), F.lit(0)) + 1
    links = counted.select(
        F.col("_seq").alias("sequence"), (F.col("_seq") + hop).cast("long").alias("_next"),
        (F.col("_pos") == 1).alias("_head"),
    ).withColumn("_chunk", F.floor((F.col("sequence") - 1) / fold_rows))
    links = durable(links)

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sequence")
        first, n = int(pdf["sequence"].iloc[0]), len(pdf)
        to = pdf["_next"].to_numpy() - first
        # Pointer doubling: rows that leave the chunk point at themselves.
        hop = np.where(to < n, to, np.arange(n))
        while True:
            further = hop[hop]
            if (further == hop).all():
                break
            hop = further
        out = pdf["_next"].to_numpy()[hop]
        heads = np.flatnonzero(pdf["_head"].to_numpy())
        known = np.zeros(n, bool)
        if len(heads):
            known[heads[-1]] = True
        return pd.DataFrame(
            {"sequence": pdf["sequence"].to_numpy(), "_exit": out, "_known": known}
        )

    walked = durable(
        links.groupBy("_chunk").applyInPandas(exits, "sequence long, _exit long, _known boolean")
    )
    crossing = links.where(F.floor((F.col("_next") - 1) / fold_rows) > F.col("_chunk")).select(
        F.col("_next").alias("sequence")
    ).distinct()
    jump = walked.join(crossing, "sequence").select("sequence", "_exit")
    reached = walked.where("_known").select(F.col("_exit").alias("sequence"))
    longest = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    for _ in range(int(longest // fold_rows + 2).bit_length()):
        jump = durable(jump)
        step = reached.join(jump, "sequence").select(F.col("_exit").alias("sequence"))
        reached = durable(reached.unionByName(step).distinct())
        far = jump.select(F.col("sequence").alias("_exit"), F.col("_exit").alias("_far"))
        jump = jump.join(far, "_exit").select("sequence", F.col("_far").alias("_exit"))
    entries = reached.select(
        F.floor((F.col("sequence") - 1) / fold_rows).alias("_chunk"),
        F.col("sequence").alias("_entry"),
    ).groupBy("_chunk").agg(F.min("_entry").alias("_entry"))

    def marks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sequence").reset_index(drop=True)
        first, n = int(pdf["sequence"].iloc[0]), len(pdf)
        heads = np.flatnonzero(pdf["_head"].to_numpy())
        entry = pdf["_entry"].iloc[0]
        begins = [] if pd.isna(entry) else [int(entry) - first]
        begins += heads[:1].tolist()
        mark = np.zeros(n, np.int64)
        if begins:
            mark[_follow(pdf["_next"].to_numpy() - first, min(begins), n)] = 1
        last = np.maximum.accumulate(np.where(mark == 1, pdf["sequence"].to_numpy(), 0))
        return pd.DataFrame(
            {"_chunk": pdf["_chunk"], "sequence": pdf["sequence"], "_mark": mark, "_last": last}
        )

    marked = durable(
        links.join(entries, "_chunk", "left").groupBy("_chunk").applyInPandas(
            marks, "_chunk long, sequence long, _mark long, _last long"
        )
    )
    # The last opened segment carries over into rows before a block's first opening.
    carried = marked.groupBy("_chunk").agg(F.max("_last").alias("_l")).select(
        "_chunk",
        F.coalesce(
            F.max("_l").over(
                Window.partitionBy(F.lit(0)).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_carry"),
    )
    opened = marked.join(carried, "_chunk").select(
        "sequence", "_mark", F.greatest("_last", "_carry").alias("_open")
    )
    joined = placed.join(opened, "sequence")
    numbered = running(
        joined.drop("position").withColumnRenamed("sequence", "_seq"),
        by, order_cols, F.col("_mark"),
    )
    return numbered.select(
        *rows.columns,
        F.col("total").cast("long").alias("segment"),
        (F.col("_seq") - F.col("_open") + 1).alias("rank"),
    )
