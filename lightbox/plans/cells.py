"""Exact vector joins over cells.

Vectors go to the cell of their nearest pivot. Geometry tells which other cells
can hold a partner, so vectors travel only there; inside a cell, blocks of
bounded size are compared by matrix products. A crowded cell is cut into as many
blocks as it needs. Where a sample shows that the bounds exclude too little to pay
for the copies, fewer cells are made, down to one grid of tiles over all vectors.
Nothing is approximate: the bounds only skip comparisons that cannot succeed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightbox.functions.vectors import to_matrix, unit_rows

BLOCK_ROWS = 4096
# What one side of a comparison may hold; a crowded cell is compared as a grid of tiles, whose
# sides grow with the crowd up to this size, so a row is copied about sqrt(blocks) times.
TILE_BYTES = 48 << 20
MAX_PIVOTS = 1024
STRIP_ROWS = 512
# Columns of one product: with a strip of rows it holds 8 MB in single precision.
STRIP_COLUMNS = 4096
SLACK = 1e-6
# Rows that show how far the bounds of a set of cells reach, and what sending a row costs in pairs compared.
PROBES = 256
COPY_COST = 20_000
# Edges that a grouping task gathers before it folds them into its forest.
MERGE_EDGES = 500_000


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows: bounds what one product holds in memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class Pivots:
    """Unit vectors that define the cells; at most ``MAX_PIVOTS``, so they fit a closure."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.rows = 0
        self.apart = np.sqrt(np.maximum(2.0 - 2.0 * points @ points.T, 0.0))

    def distances(self, units: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2.0 - 2.0 * units @ self.points.T, 0.0))

    def bisector_gap(self, d: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Distance from each vector to the border of every other cell."""
        own = d[np.arange(len(d)), home]
        apart = self.apart[home]
        gap = np.full_like(d, 0.0)
        np.divide(d**2 - own[:, None] ** 2, 2.0 * apart, out=gap, where=apart > 0)
        return gap


def by_length(vectors: DataFrame) -> dict[int, tuple[DataFrame, int]]:
    """The directed vectors of each length, with their number.

    Null, empty and zero vectors have no direction and take no part. Vectors of
    different lengths cannot be compared; each length is joined with its own kind.
    """
    embedding = F.col("embedding")
    directed = vectors.where(embedding.isNotNull() & F.exists(embedding, lambda x: x != 0))
    sizes = directed.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()
    return {r["dim"]: (directed.where(F.size("embedding") == r["dim"]), r["n"]) for r in sizes}


def _sample(vectors: DataFrame, rows: int, dim: int) -> np.ndarray:
    """Unit vectors of the first rows in seeded hash order."""
    sample = (
        vectors.select("id", "embedding")
        .orderBy(F.md5(F.concat(F.lit("pivot:"), F.coalesce(F.col("id").cast("string"), F.lit("")))), "id")
        .limit(rows)
        .toArrow()
    )
    return unit_rows(to_matrix(sample.column("embedding"), dim)[0])


def _tiles_of(rows: float, block_rows: int, dim: int) -> int:
    """:func:`tiles` of one number."""
    blocks = int(np.ceil(rows / block_rows))
    return int(max(1, np.ceil(np.sqrt(blocks)), np.ceil(rows * 8 * dim / TILE_BYTES)))


def _cost(pivots: Pivots, probes: np.ndarray, n: int, radius: float, block_rows: int) -> float:
    """Expected work per vector with these cells: pairs compared, and copies sent as :data:`COPY_COST` pairs each."""
    d = pivots.distances(probes)
    home = d.argmin(axis=1)
    near = pivots.bisector_gap(d, home) <= radius + SLACK
    cells = d.shape[1]
    # A vector is the guest of the lower half of the cells that it reaches.
    guests = (near.sum(axis=1).mean() - 1.0) / 2.0
    held = (1.0 + guests) * n / cells
    return (0.5 + guests) * n / cells + COPY_COST * (1.0 + guests) * _tiles_of(held, block_rows, probes.shape[1])


def choose_pivots(vectors: DataFrame, n: int, dim: int, radius: float, block_rows: int = BLOCK_ROWS) -> Pivots:
    """A seeded sample of the ``n`` directed vectors of one length: at most about one per block of rows, and of
    these as many as make the work least by a sample of further vectors."""
    wanted = int(min(max(n // block_rows, 1), MAX_PIVOTS))
    units = _sample(vectors, wanted + (PROBES if wanted > 1 else 0), dim)
    points, probes = units[:wanted], units[wanted:] if len(units) > wanted else units
    best, least = Pivots(points[:1]), np.inf
    while True:
        pivots = Pivots(np.unique(points, axis=0))
        cost = _cost(pivots, probes, n, radius, block_rows)
        if cost < least or len(points) == 1 and cost <= least:
            best, least = pivots, cost
        if len(points) == 1:
            break
        points = points[: max(1, len(points) // 4)]
    best.rows = n
    return best


# Rows sent to other cells leave in slices of this size, so a batch never multiplies in memory.
EMIT_ROWS = 8192


def _place(
    rows: pa.RecordBatch, home: np.ndarray, guest: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """The rows (id, embedding, weight) in their home cell and as guests, vectors as they are stored."""
    row, cell = np.nonzero(guest)
    row, cell = np.concatenate([np.arange(len(home)), row]), np.concatenate([home, cell])
    for lo in range(0, len(row), EMIT_ROWS):
        r = pa.array(row[lo : lo + EMIT_ROWS])
        yield pa.RecordBatch.from_arrays(
            [
                rows.column(0).take(r), rows.column(2).take(r), pa.array(cell[lo : lo + EMIT_ROWS], pa.int32()),
                pa.array(np.arange(lo, lo + len(r)) < len(home)), rows.column(1).take(r),
            ],
            ["id", "weight", "cell", "home", "embedding"],
        )


def place_for_radius(vectors: DataFrame, pivots: Pivots, radius: float) -> DataFrame:
    """Each vector in its home cell and, as a guest, in every lower cell that may
    hold a partner within ``radius``: a pair then meets in exactly one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, STRIP_ROWS * 4):
            matrix, ok = to_matrix(batch.column(1), pivots.points.shape[1])
            ok &= matrix.any(axis=1)
            units = unit_rows(matrix[ok])
            if not len(units):
                continue
            d = pivots.distances(units)
            home = d.argmin(axis=1)
            near = pivots.bisector_gap(d, home) <= radius + SLACK
            guest = near & (np.arange(d.shape[1])[None, :] < home[:, None])
            yield from _place(batch.filter(pa.array(ok)), home, guest)

    weight = F.col("weight").cast("long") if "weight" in vectors.columns else F.lit(1).cast("long").alias("weight")
    if len(pivots.points) == 1:
        # One cell: everything is at home where it lies.
        return vectors.select(F.col("id").cast("long"), weight, F.lit(0).alias("cell"), F.lit(True).alias("home"), "embedding")
    kind = vectors.schema["embedding"].dataType.simpleString()
    row = f"id long, weight long, cell int, home boolean, embedding {kind}"
    return vectors.select(F.col("id").cast("long"), "embedding", weight).mapInArrow(run, row)


def tiles(rows, block_rows: int, dim: int):
    """Blocks that a cell of so many rows is cut into, as a column: the root of its blocks of ``block_rows``, more
    where a block would exceed ``TILE_BYTES``."""
    blocks = F.ceil(rows / F.lit(block_rows))
    return F.greatest(F.ceil(F.sqrt(blocks)), F.ceil(rows * F.lit(8 * dim) / F.lit(TILE_BYTES))).cast("int")


def _cut(placed: DataFrame, block_rows: int, dim: int, fits_one: bool) -> DataFrame:
    """Assign blocks inside cells and copy each row to the block pairs it takes part in."""
    if fits_one:
        zero = F.lit(0)
        return placed.select(
            "cell", zero.alias("lo"), zero.alias("hi"), zero.alias("block"), "id", "weight", "home", "embedding"
        )
    # One row per cell, at most MAX_PIVOTS of them.
    counts = placed.select("cell").groupBy("cell").agg(
        tiles(F.count("*"), block_rows, dim).alias("blocks")
    )
    cut = placed.join(F.broadcast(counts), "cell").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return cut.withColumn("_o", other).select(
        "cell", F.least("block", "_o").alias("lo"), F.greatest("block", "_o").alias("hi"),
        "block", "id", "weight", "home", "embedding",
    )


class _Tile:
    """One block pair: rows of both blocks in one order, those at home first in each block."""

    def __init__(self, table: pa.Table):
        ids, home = table.column("id").to_numpy(), table.column("home").to_numpy()
        block = table.column("block").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        order = np.lexsort((ids, ~home, block))
        self.ids, self.weight = ids[order], table.column("weight").to_numpy()[order]
        self.units = unit_rows(to_matrix(table.column("embedding"))[0])[order]
        self.single = self.units.astype(np.float32)
        first = int((block == lo).sum())
        own = home[order]
        self.same = lo == hi
        if self.same:
            at_home = int(own.sum())
            # Pairs of two at home once, then those at home with guests; two guests meet elsewhere.
            self.spans = [(0, at_home, 0, at_home), (0, at_home, at_home, len(ids))]
            self.repeated = len(np.unique(ids)) < len(ids)
        else:
            a, b = int(own[:first].sum()), first + int(own[first:].sum())
            self.spans = [(0, a, first, len(ids)), (a, first, first, b)]
            self.repeated = False

    def matches(self, min_dot: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, rows, dots) of qualifying pairs, a product at a time.

        Products are taken in single precision and what may qualify is computed again in double.
        """
        below = np.float32(min_dot - 4.0 * (self.units.shape[1] + 8) * 2.0**-24)
        for k, (r0, r1, c0, c1) in enumerate(self.spans):
            triangle = self.same and k == 0
            for a in range(r0, r1, STRIP_ROWS):
                z = min(a + STRIP_ROWS, r1)
                for b in range(a if triangle else c0, c1, STRIP_COLUMNS):
                    y = min(b + STRIP_COLUMNS, c1)
                    may = (self.single[a:z] @ self.single[b:y].T >= below).ravel()
                    some = np.count_nonzero(may)
                    if not some:
                        continue
                    if some > may.size // 50:
                        dots = (self.units[a:z] @ self.units[b:y].T).ravel()
                        at = np.flatnonzero(dots >= min_dot)
                        dots = dots[at]
                        i, j = np.divmod(at, y - b)
                        i, j = i + a, j + b
                    else:
                        i, j = np.divmod(np.flatnonzero(may), y - b)
                        i, j = i + a, j + b
                        dots = np.einsum("ij,ij->i", self.units[i], self.units[j])
                    keep = dots >= min_dot
                    if triangle:
                        keep &= i < j
                    if self.repeated:
                        keep &= self.ids[i] != self.ids[j]
                    if keep.any():
                        yield i[keep], j[keep], dots[keep]


def _fold(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Take edges between positions into their labels, each the least position reachable."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(label, np.maximum(a, b), low)
        while (label[label] != label).any():
            label[:] = label[label]


def pairs_within(
    vectors: DataFrame, threshold: float, emit: str = "pairs", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Pairs whose cosine distance is at most ``threshold``.

    ``emit`` is ``pairs`` (a, b, distance), ``forest`` (u, v: edges that connect
    the same items, never more than rows compared), ``count`` (n) or ``degree``
    (id, n, nearest: one row per item and block). With a column ``weight``, how many
    equal vectors a row stands for, the last two count those.
    """
    radius = float(np.sqrt(max(2.0 * threshold, 0.0)))
    min_dot = 1.0 - threshold

    def pairs(table: pa.Table) -> pa.Table:
        tile = _Tile(table)
        found = list(tile.matches(min_dot)) or [(np.empty(0, np.int64),) * 2 + (np.empty(0),)]
        x, y, s = (np.concatenate(c) for c in zip(*found))
        x, y = tile.ids[x], tile.ids[y]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "distance": np.maximum(1.0 - s, 0.0)})

    def spanning(table: pa.Table) -> pa.Table:
        tile = _Tile(table)
        label, held, waiting = np.arange(len(tile.ids)), 0, []
        for i, j, _ in tile.matches(min_dot):
            apart = label[i] != label[j]
            waiting.append((i[apart], j[apart]))
            held += int(apart.sum())
            if held > MERGE_EDGES:
                _fold(label, *(np.concatenate(c) for c in zip(*waiting)))
                held, waiting = 0, []
        if waiting:
            _fold(label, *(np.concatenate(c) for c in zip(*waiting)))
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"u": pa.array(tile.ids[moved]), "v": pa.array(tile.ids[label[moved]])})

    def count(table: pa.Table) -> pa.Table:
        tile = _Tile(table)
        return pa.table({"n": pa.array([sum(int(tile.weight[i] @ tile.weight[j]) for i, j, _ in tile.matches(min_dot))], pa.int64())})

    def degree(table: pa.Table) -> pa.Table:
        tile = _Tile(table)
        n, near = np.zeros(len(tile.ids), np.int64), np.full(len(tile.ids), np.inf)
        for i, j, s in tile.matches(min_dot):
            far = np.maximum(1.0 - s, 0.0)
            for one, other in ((i, j), (j, i)):
                np.add.at(n, one, tile.weight[other])
                np.minimum.at(near, one, far)
        met = np.flatnonzero(n)
        return pa.table({"id": pa.array(tile.ids[met]), "n": pa.array(n[met]), "nearest": pa.array(near[met])})

    fn, schema = {
        "pairs": (pairs, "a long, b long, distance double"),
        "forest": (spanning, "u long, v long"),
        "count": (count, "n long"),
        "degree": (degree, "id long, n long, nearest double"),
    }[emit]
    out = []
    for dim, (mine, n) in by_length(vectors).items():
        placed = place_for_radius(mine, choose_pivots(mine, n, dim, radius, block_rows), radius)
        out.append(_cut(placed, block_rows, dim, n <= block_rows).groupBy("cell", "lo", "hi").applyInArrow(fn, schema))
    if not out:
        return vectors.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, out)
