"""Exact k nearest neighbours in two passes over a tree of pivots.

A seeded sample of the corpus makes leaf pivots, about two per block of rows; some of them
are also tops, and every leaf hangs below its nearest top. A corpus vector lies in the leaf nearest
to it below the top nearest to it. First each query looks into its own leaf, or as many leaves
around it as hold k vectors: the k-th best distance found there is a true bound. In the
second pass it visits only leaves that the bound cannot exclude, by rings (least and greatest
distance of a leaf's vectors to its pivot) and by bisectors between siblings; whole tops
are excluded before their leaves are looked at. Crowded leaves are cut into blocks.
Where a sample of the queries shows that the bounds exclude too little to pay for the copies, one grid of tiles over all
vectors takes the place of both passes. Vectors travel as they are stored and are scaled to length one where they are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lightbox.functions.vectors import to_matrix, unit_rows
from lightbox.plans.cells import BLOCK_ROWS, COPY_COST, EMIT_ROWS, SLACK, STRIP_COLUMNS, STRIP_ROWS, by_length, slices
from lightbox.session import durable

TREE_BYTES = 32 << 20  # of all pivots; beyond that many leaves, leaves hold more than one block
TIE, PAIRS = 1e-12, 65_536  # distances that may be equal, and pairs compared at once
PROBED = 64  # one query of so many tells how far the bounds reach
SIDE_BYTES = 96 << 20  # of the corpus vectors that one tile holds in double precision
FOUND = "query_id long, id long, distance double"


def _distances(units: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * units @ points.T, 0.0))


def _gaps(d: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Least distance from each vector to what lies nearer to each pivot than to the vector's nearest one."""
    own = d.argmin(axis=1)
    gap = np.zeros_like(d)
    between = apart[own]
    np.divide(d**2 - d[np.arange(len(d)), own][:, None] ** 2, 2.0 * between, out=gap, where=between > 0)
    return gap


class Tree:
    """Leaf pivots below top pivots, and what is known of the vectors of every leaf and top."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        tops = np.random.default_rng(0).permutation(n)[: int(np.ceil(np.sqrt(n)))]
        self.tops = points[tops]
        above = _distances(points, self.tops).argmin(axis=1)
        order = np.argsort(above, kind="stable")
        self.leaves, self.above = points[order], above[order]
        self.first = np.searchsorted(self.above, np.arange(len(tops) + 1))
        self.apart = _distances(self.tops, self.tops)
        self.size = np.zeros(n, np.int64)
        self.near, self.far = np.zeros(n), np.zeros(n)
        self.top_near, self.top_far = np.full(len(tops), np.inf), np.full(len(tops), -np.inf)

    def know(self, stats: pa.Table) -> None:
        """Take in (cell, n, near, far, top_near, top_far), a row per leaf with vectors."""
        at = stats.column("cell").to_numpy()
        self.size[at] = stats.column("n").to_numpy()
        self.near[at], self.far[at] = stats.column("near").to_numpy(), stats.column("far").to_numpy()
        np.minimum.at(self.top_near, self.above[at], stats.column("top_near").to_numpy())
        np.maximum.at(self.top_far, self.above[at], stats.column("top_far").to_numpy())

    def below(self, top: int) -> slice:
        return slice(int(self.first[top]), int(self.first[top + 1]))

    def settle(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, distance to its pivot, distance to its top's pivot) of corpus vectors."""
        d = _distances(units, self.tops)
        top = d.argmin(axis=1)
        leaf, reach = np.empty(len(units), np.int64), np.empty(len(units))
        for t in np.unique(top):
            rows = np.flatnonzero(top == t)
            under = _distances(units[rows], self.leaves[self.below(t)])
            leaf[rows] = under.argmin(axis=1) + self.first[t]
            reach[rows] = under.min(axis=1)
        return leaf, reach, d[np.arange(len(units)), top]

    def homes(self, units: np.ndarray, wanted: np.ndarray) -> list[list[int]]:
        """For each query the leaves around it that together hold the wanted number of vectors, or all there are."""
        out: list[list[int]] = [[] for _ in units]
        order = _distances(units, self.tops).argsort(axis=1)
        left = wanted.copy()
        open_rows = np.arange(len(units))
        for step in range(len(self.tops)):
            top = order[open_rows, step]
            for t in np.unique(top):
                rows = open_rows[top == t]
                under = np.flatnonzero(self.size[self.below(t)] > 0) + self.first[t]
                if not len(under):
                    continue
                by = under[_distances(units[rows], self.leaves[under]).argsort(axis=1)]
                held = np.cumsum(self.size[by], axis=1)
                used = np.minimum((held < left[rows][:, None]).sum(axis=1) + 1, len(under))
                for r, m, cells, h in zip(rows, used, by, held):
                    out[r] += cells[:m].tolist()
                    left[r] -= h[m - 1]
            open_rows = open_rows[left[open_rows] > 0]
            if not len(open_rows):
                break
        return out

    def within(self, units: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) wherever a leaf may hold a vector within a query's bound."""
        rows, cells = [], []
        d = _distances(units, self.tops)
        low = np.maximum(np.maximum(d - self.top_far, self.top_near - d), _gaps(d, self.apart))
        alive = low <= bound[:, None]
        for t in np.flatnonzero(alive.any(axis=0)):
            mine = np.flatnonzero(alive[:, t])
            span = self.below(t)
            points = self.leaves[span]
            d = _distances(units[mine], points)
            low = np.maximum(np.maximum(d - self.far[span], self.near[span] - d), _gaps(d, _distances(points, points)))
            r, c = np.nonzero((low <= bound[mine][:, None]) & (self.size[span] > 0))
            rows.append(mine[r])
            cells.append(c + self.first[t])
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(rows), np.concatenate(cells)


def choose_tree(vectors: DataFrame, n: int, dim: int, block_rows: int = BLOCK_ROWS) -> Tree:
    """Pivots from a seeded sample of the ``n`` directed vectors of one length, bounded by ``TREE_BYTES``."""
    wanted = int(min(max(2 * n // block_rows, 1) if n > block_rows else 1, max(1, TREE_BYTES // (8 * dim))))
    sample = (
        vectors.select("id", "embedding")
        .orderBy(F.md5(F.concat(F.lit("pivot:"), F.coalesce(F.col("id").cast("string"), F.lit("")))), "id")
        .limit(wanted).toArrow()
    )
    return Tree(np.unique(unit_rows(to_matrix(sample.column("embedding"), dim)[0]), axis=0))


def _directed(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask of usable rows, their unit vectors)."""
    matrix, ok = to_matrix(batch.column(1), dim)
    ok &= matrix.any(axis=1)
    return ok, unit_rows(matrix[ok])


def _schema(vectors: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    kind = vectors.schema["embedding"].dataType
    return T.StructType([T.StructField("id", T.LongType()), *[T.StructField(n, t) for n, t in fields], T.StructField("embedding", kind)])


def _settled(corpus: DataFrame, tree: Tree, dim: int, skip: str | None) -> DataFrame:
    """Corpus vectors with their leaf and distances, and the queries they must not answer."""
    extra = [] if skip is None else [F.col(skip).cast("array<long>").alias("skip")]
    fields = [("cell", T.IntegerType()), ("reach", T.DoubleType()), ("top_reach", T.DoubleType())]
    if extra:
        fields.append(("skip", T.ArrayType(T.LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, STRIP_ROWS * 4):
            ok, units = _directed(batch, dim)
            if len(units):
                leaf, reach, top = tree.settle(units)
                kept = batch.filter(pa.array(ok))
                columns = [kept.column(0), pa.array(leaf, pa.int32()), pa.array(reach), pa.array(top)]
                columns += [kept.column(2)] if skip is not None else []
                yield pa.RecordBatch.from_arrays([*columns, kept.column(1)], ["id", *[n for n, _ in fields], "embedding"])

    return corpus.select(F.col("id").cast("long"), "embedding", *extra).mapInArrow(run, _schema(corpus, *fields))


def _at_home(queries: DataFrame, tree: Tree, dim: int, need: int, barred: bool) -> DataFrame:
    """Queries with the leaves of their first pass, written once so that both passes agree on them."""
    extra = [F.col("barred").cast("long")] if barred else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, STRIP_ROWS * 2):
            ok, units = _directed(batch, dim)
            if len(units):
                kept = batch.filter(pa.array(ok))
                wanted = np.full(len(units), need, np.int64)
                if barred:
                    wanted += kept.column(2).fill_null(0).to_numpy(zero_copy_only=False)
                homes = tree.homes(units, wanted)
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), pa.array(homes, pa.list_(pa.int32())), kept.column(1)], ["id", "homes", "embedding"]
                )

    asked = queries.select(F.col("id").cast("long"), "embedding", *extra)
    return asked.mapInArrow(run, _schema(queries, ("homes", T.ArrayType(T.IntegerType()))))


def further_visits(asked: DataFrame, bounds: DataFrame, tree: Tree, dim: int) -> DataFrame:
    """(id, cell, embedding): leaves beyond the first pass that may hold a vector within a query's bound."""
    b = bounds.select(F.col("query_id").alias("_q"), "bound")
    rows = asked.join(b, F.col("id").eqNullSafe(F.col("_q")), "left").select("id", "embedding", "homes", "bound")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = len(tree.leaves)
        for batch in slices(batches, STRIP_ROWS * 2):
            _, units = _directed(batch, dim)
            bound = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            chord = np.where(np.isnan(bound), np.inf, np.sqrt(2.0 * np.maximum(bound, 0.0)) + SLACK)
            row, cell = tree.within(units, chord)
            homes = batch.column(2)
            seen = np.repeat(np.arange(batch.num_rows), np.asarray(homes.value_lengths())) * cells + homes.flatten().to_numpy()
            new = ~np.isin(row * cells + cell, seen)
            row, cell = row[new], cell[new]
            for lo in range(0, len(row), EMIT_ROWS):
                r = pa.array(row[lo : lo + EMIT_ROWS])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(r), pa.array(cell[lo : lo + EMIT_ROWS], pa.int32()), batch.column(1).take(r)],
                    ["id", "cell", "embedding"],
                )

    return rows.mapInArrow(run, _schema(asked, ("cell", T.IntegerType())))


def _sides(rows: float, block_rows: int, dim: int, cores: int) -> int:
    """Parts of one side of a grid: blocks up to what keeps all cores busy, more only where a part would outgrow a task.
    A vector goes to as many tiles as the other side has parts, so copies stay few as the tables grow."""
    busy = min(np.ceil(np.sqrt(np.ceil(rows / block_rows))), np.ceil(np.sqrt(4 * cores)))
    return int(max(1, busy, np.ceil(rows * 8 * dim / SIDE_BYTES)))


def _answers(visits: DataFrame, settled: DataFrame, visitors: np.ndarray, size: np.ndarray, k: int, skip_same_id: bool, block_rows: int, dim: int) -> DataFrame:
    """The k best of every visit, block by block of queries and corpus vectors of a leaf."""
    cores = visits.sparkSession.sparkContext.defaultParallelism
    own, others = (np.array([_sides(n, block_rows, dim, cores) if n else 0 for n in rows], np.int64) for rows in (visitors, size))
    used = np.flatnonzero((own > 0) & (others > 0))
    # At most one row per leaf.
    cut = visits.sparkSession.createDataFrame(
        pa.table({"cell": pa.array(used, pa.int32()), "own": pa.array(own[used], pa.int32()), "others": pa.array(others[used], pa.int32())})
    )
    left = visits.join(F.broadcast(cut), "cell").withColumns({
        "q": F.pmod(F.xxhash64("id"), F.col("own")).cast("int"), "c": F.explode(F.sequence(F.lit(0), F.col("others") - 1)),
    })
    right = settled.join(F.broadcast(cut), "cell").withColumns({
        "c": F.pmod(F.xxhash64("id"), F.col("others")).cast("int"), "q": F.explode(F.sequence(F.lit(0), F.col("own") - 1)),
    })
    skips = "skip" in settled.columns

    def best(lt: pa.Table, rt: pa.Table) -> pa.Table:
        out = []
        if lt.num_rows and rt.num_rows:
            qid, cid = lt.column("id").to_numpy(), rt.column("id").to_numpy()
            cm = unit_rows(to_matrix(rt.column("embedding"), dim)[0])
            barred = None
            if skips:
                lists = rt.column("skip").combine_chunks()
                sizes = np.asarray(lists.value_lengths().fill_null(0))
                barred = (np.repeat(np.arange(len(cid)), sizes), lists.flatten().to_numpy(zero_copy_only=False))
            for start in range(0, len(qid), STRIP_ROWS):
                q = qid[start : start + STRIP_ROWS]
                qm = unit_rows(to_matrix(lt.column("embedding").slice(start, STRIP_ROWS), dim)[0])
                least, met = np.full(len(q), np.inf), []
                for c0 in range(0, len(cid), STRIP_COLUMNS):
                    c1 = min(c0 + STRIP_COLUMNS, len(cid))
                    dist = np.maximum(1.0 - qm @ cm[c0:c1].T, 0.0)
                    if skip_same_id:
                        dist[q[:, None] == cid[None, c0:c1]] = np.inf
                    if barred is not None:
                        by_id = q.argsort()
                        mine = (barred[0] >= c0) & (barred[0] < c1)
                        column, asker = barred[0][mine] - c0, barred[1][mine]
                        rows = by_id[np.minimum(np.searchsorted(q[by_id], asker), len(q) - 1)]
                        hit = q[rows] == asker
                        dist[rows[hit], column[hit]] = np.inf
                    # The k-th best of any columns is no nearer than that of all.
                    if c0 == 0 and dist.shape[1] > k:
                        least = np.partition(dist, k - 1, axis=1)[:, k - 1]
                    i, j = np.nonzero(np.isfinite(dist) & (dist <= least[:, None] + TIE))
                    met.append((i, j + c0))
                # A product's last digits depend on its shape. What may be among the k best is computed again
                # pair by pair, so equal vectors are equally far and their ids decide.
                i, j = (np.concatenate(c) for c in zip(*met))
                far = np.concatenate([
                    1.0 - np.einsum("ij,ij->i", qm[i[a : a + PAIRS]], cm[j[a : a + PAIRS]]) for a in range(0, len(i), PAIRS)
                ] or [np.empty(0)])
                far = np.maximum(far, 0.0)
                order = np.lexsort((cid[j], far, i))
                i, j, far = i[order], j[order], far[order]
                kept = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append((q[i[kept]], cid[j[kept]], far[kept]))
        x, y, s = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"query_id": x, "id": y, "distance": s})

    keys = ["cell", "q", "c"]
    return (
        left.select(*keys, "id", "embedding").groupBy(*keys)
        .cogroup(right.select(*keys, "id", "embedding", *(["skip"] if skips else [])).groupBy(*keys))
        .applyInArrow(best, FOUND)
    )


def _of_length(queries, corpus, n: int, dim: int, k: int, skip_same_id: bool, block_rows: int, skip: str | None) -> DataFrame:
    tree = choose_tree(corpus, n, dim, block_rows)
    cells = len(tree.leaves)
    settled = _settled(corpus, tree, dim, skip)
    need = k + 1 if skip_same_id else k
    rest = (k, skip_same_id, block_rows, dim)
    if cells == 1:
        tree.size[0] = n
        everyone = queries.select(F.col("id").cast("long"), "embedding", F.lit(0).cast("int").alias("cell"))
        directed = everyone.where(F.exists("embedding", lambda x: x != 0))
        return _answers(directed, settled, np.array([directed.count()]), tree.size, *rest)
    settled = durable(settled)
    # At most one row per leaf.
    tree.know(settled.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("reach").alias("near"), F.max("reach").alias("far"),
        F.min("top_reach").alias("top_near"), F.max("top_reach").alias("top_far"),
    ).toArrow())
    asked = durable(_at_home(queries, tree, dim, need, skip is not None))

    def visitors(visits: DataFrame) -> np.ndarray:
        counted = visits.groupBy("cell").agg(F.count("*").alias("n")).toArrow()
        out = np.zeros(cells, np.int64)
        out[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
        return out

    def within_home(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The k best of the first pass, and the bounds that they give."""
        first = some.select("id", F.explode("homes").alias("cell"), "embedding")
        at_home = durable(_answers(first, settled, visitors(first.select("cell")), tree.size, *rest))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        kept = durable(at_home.withColumn("rank", rank).where(F.col("rank") <= k))
        return kept, kept.where(F.col("rank") == k).select("query_id", F.col("distance").alias("bound"))

    # A few queries go first: where their bounds exclude too little, the others need none.
    few = asked.where(F.pmod(F.xxhash64("id", F.lit(37)), F.lit(PROBED)) == 0)
    probed, n_asked = few.count(), asked.count()
    each = further_visits(few, within_home(few)[1], tree, dim).count() / max(probed, 1)
    # Work per query: pairs compared, and copies of vectors, of the query and of the corpus, at their cost in pairs.
    by_leaf = each * (n / cells + COPY_COST)
    cores = asked.sparkSession.sparkContext.defaultParallelism
    copies = _sides(n, block_rows, dim, cores) + _sides(n_asked, block_rows, dim, cores) * n / max(n_asked, 1)
    if probed and by_leaf > n + COPY_COST * copies:
        everywhere = asked.select("id", F.lit(0).alias("cell"), "embedding")
        return _answers(everywhere, settled.withColumn("cell", F.lit(0)), np.array([n_asked]), np.array([n]), *rest)
    kept, bounds = within_home(asked)
    more = durable(further_visits(asked, bounds, tree, dim))
    return kept.select("query_id", "id", "distance").unionByName(
        _answers(more, settled, visitors(more.select("cell")), tree.size, *rest)
    )


def nearest(
    queries: DataFrame, corpus: DataFrame, k: int, skip_same_id: bool, block_rows: int = BLOCK_ROWS, skip: str | None = None,
) -> DataFrame:
    """(query_id, id, distance): candidates that contain the exact k nearest of every query,
    among the corpus vectors of the query's own length.

    With ``skip`` the corpus carries an array column of query ids it must not answer, and
    the queries a column ``barred``: how many corpus rows that concerns, so that the first pass
    looks at enough vectors. Repeated query ids share one list.
    """
    asked = queries.where(F.col("embedding").isNotNull())
    out = [
        _of_length(asked.where(F.size("embedding") == dim), mine, n, dim, k, skip_same_id, block_rows, skip)
        for dim, (mine, n) in by_length(corpus).items()
    ]
    if not out:
        return queries.sparkSession.createDataFrame([], FOUND)
    return reduce(DataFrame.unionByName, out)
