"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Entries become whole numbers ``floor(64 * c) + 1000000``. The fit list holds every distinct
vector once. Tasks add up its exact sums, then its scatter centred at the exact mean; both
are one row of numbers per task, added again in a second round of at most ``MERGERS`` tasks
before the driver sees them, so what reaches it does not grow with the rows. The scatter is
factored as ``P L L' P'``; plane rotations make the columns of L orthogonal. Their squared
norms are the eigenvalues of the scatter and the normalised columns, unpivoted, its
eigenvectors. No product that would square the condition of L is formed.

Rows whose vector is null or holds null or non-finite entries are dropped. Entries beyond
2 ** 61 / 64 count as that bound. Vectors of different lengths are whitened apart, each
length with its own fit list. Directions without variance (at most ``RANK`` of the
trace) have no component, so a lone vector, copies of one vector and empty vectors give no rows. A
null or repeated ``vec_id`` is kept as it is. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightbox.session import durable

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
BOUND = float(1 << 61)
MERGERS = 32
SWEEPS = 60
RANK = 1e-13


def whole_numbers(vector: Column) -> Column:
    """The vector's entries as whole numbers, null if one of them is null or not finite."""
    entries = vector.cast("array<double>")
    bad = F.exists(entries, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    scaled = F.transform(entries, lambda e: F.floor(F.greatest(F.least(e * SCALE, F.lit(BOUND)), F.lit(-BOUND))) + SHIFT)
    return F.when(~bad, scaled)


def _matrix(column: pa.ListArray, at: np.ndarray) -> np.ndarray:
    """The listed rows of equally long lists."""
    picked = column.take(pa.array(at))
    return picked.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)


def _by_width(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of equally long vectors of a batch: (batch, their numbers, matrix)."""
    for batch in batches:
        column = batch.column(name)
        widths = np.asarray(column.value_lengths())
        for w in np.unique(widths[widths > 0]):
            at = np.flatnonzero(widths == w)
            yield batch, at, _matrix(column, at)


PARTIAL = "width int, kind string, line int, n long, high array<long>, low array<long>, sums array<double>"


def _merged(partials: DataFrame) -> DataFrame:
    """Sums of partial rows, by (width, kind, line): in up to ``MERGERS`` tasks, a row at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["width"], row["kind"], row["line"])
                own = [row["n"], *[np.array(row[c]) if row[c] is not None else None for c in ("high", "low", "sums")]]
                if key not in total:
                    total[key] = own
                else:
                    total[key] = [a if b is None else b if a is None else a + b for a, b in zip(total[key], own)]
        yield from _partial_rows((*key, *value) for key, value in total.items())

    return partials.repartition(MERGERS, "width", "kind", "line").mapInArrow(add, PARTIAL)


def _partial_rows(rows) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PARTIAL.split(", ")]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
    columns = list(zip(*rows)) or [[] for _ in names]
    plain = [[v.tolist() if isinstance(v, np.ndarray) else v for v in c] for c in columns]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(plain, kinds)], names)


def sums_of(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """width: (number of vectors, exact sums per dimension). Sums travel as two halves, so no addition overflows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for _, _, x in _by_width(batches, "x"):
            n, high, low = total.get(x.shape[1], (0, 0, 0))
            total[x.shape[1]] = [n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)]
        yield from _partial_rows((w, "sums", 0, n, high, low, None) for w, (n, high, low) in total.items())

    rows = _merged(fit.mapInArrow(partial, PARTIAL)).collect()
    return {r.width: (r.n, [(h << 32) + lo for h, lo in zip(r.high, r.low)]) for r in rows}


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n in double precision: whole parts are taken off before rounding."""
    whole = np.array([s // n for s in sums])
    return (x - whole) - np.array([s % n / n for s in sums])


def scatter_of(fit: DataFrame, sums: dict[int, tuple[int, list[int]]], project: dict[int, np.ndarray] | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """width: (sum, sum of outer products) of the centred vectors, or of their images under ``project``."""
    shared = fit.sparkSession.sparkContext.broadcast((sums, project))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, project = shared.value
        total: dict[int, np.ndarray] = {}
        for _, _, x in _by_width(batches, "x"):
            w = x.shape[1]
            y = centred(x, *sums[w])
            if project is not None:
                y = y @ project[w]
            part = np.vstack([y.sum(axis=0), y.T @ y])
            total[w] = total[w] + part if w in total else part
        yield from _partial_rows(
            (w, "scatter", i, 0, None, None, line) for w, lines in total.items() for i, line in enumerate(lines)
        )

    out: dict[int, dict[int, list[float]]] = {}
    for r in _merged(fit.mapInArrow(partial, PARTIAL)).collect():
        out.setdefault(r.width, {})[r.line] = r.sums
    whole = {w: np.array([lines[i] for i in range(len(lines))]) for w, lines in out.items()}
    return {w: (m[0], m[1:]) for w, m in whole.items()}


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with ``a[order][:, order] = L L'``: the largest remaining diagonal is next; stops where none is left."""
    a = a.copy()
    d = len(a)
    order = np.arange(d)
    lower = np.zeros((d, d))
    least = RANK * max(float(np.trace(a)), 0.0)
    for k in range(d):
        p = k + int(np.argmax(np.diagonal(a)[k:]))
        if not a[p, p] > least:
            return lower[:, :k], order
        for m in (a, a.T, lower, order):
            m[[k, p]] = m[[p, k]]
        pivot = np.sqrt(a[k, k])
        lower[k, k] = pivot
        lower[k + 1 :, k] = a[k + 1 :, k] / pivot
        a[k + 1 :, k + 1 :] -= np.outer(lower[k + 1 :, k], lower[k + 1 :, k])
    return lower, order


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Disjoint pairs of columns, round by round, so that every pair meets once (circle method)."""
    m = n + n % 2
    ring = list(range(m))
    out = []
    for _ in range(m - 1):
        pairs = [(a, b) for a, b in zip(ring[: m // 2], reversed(ring[m // 2 :])) if max(a, b) < n]
        out.append((np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """``factor`` with its columns rotated until they are orthogonal."""
    g = factor.copy()
    near = np.finfo(float).eps * np.sqrt(len(g))  # cosines below this are rounding
    rounds = _rounds(g.shape[1]) if g.shape[1] > 1 else []
    for _ in range(SWEEPS):
        turned = False
        for i, j in rounds:
            a, b = g[:, i], g[:, j]
            alpha, beta, gamma = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            size = np.sqrt(alpha) * np.sqrt(beta)
            turn = np.abs(gamma) > near * size
            if not turn.any():
                continue
            turned = True
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1.0)
            sign = np.where(zeta >= 0, 1.0, -1.0)
            t = np.where(turn, sign / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            g[:, i], g[:, j] = c * a - s * b, s * a + c * b
        if not turned:
            break
    return g


@dataclass
class Whitening:
    """Means, components (columns) and eigenvalues of the vectors of one length."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def weights(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def components_of(scatter: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(unit eigenvectors as columns, eigenvalues, trace) of scatter / n, largest first."""
    lower, order = pivoted_cholesky(scatter)
    g = one_sided_jacobi(lower)
    norms = np.sqrt((g * g).sum(axis=0))
    by = np.argsort(-norms, kind="stable")
    # Rounding ends long before: what is left below this has no direction of its own.
    by = by[norms[by] ** 2 > RANK * max(float(np.trace(scatter)), 0.0)][:most]
    vectors = np.empty((len(scatter), len(by)))
    vectors[order] = g[:, by] / norms[by]
    return vectors, norms[by] ** 2 / n, float(np.trace(scatter)) / n


def train(embeddings: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of every vector length, fitted on the distinct vectors of all rows."""
    fit = durable(embeddings.select(whole_numbers(F.col(vector)).alias("x")).where("size(x) > 0").distinct())
    sums = sums_of(fit)
    model = {}
    for w, (_, scatter) in scatter_of(fit, sums).items():
        n, s = sums[w]
        vectors, values, trace = components_of(scatter, n, most)
        if len(values):
            model[w] = Whitening(n, s, vectors, values, trace)
    if model:
        known = fit.where(F.size("x").isin(*model))
        for w, (mean, gram) in scatter_of(known, sums, {w: m.weights() for w, m in model.items()}).items():
            n = model[w].n
            cov = gram / n - np.outer(mean / n, mean / n)
            model[w].identity_error = float(np.abs(cov - np.eye(len(cov))).max())
    return model


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n * x - S) ** 2; null beyond a long."""
    whole, rest = np.array([s // n for s in sums]), np.array([s % n for s in sums])
    off = x - whole
    most = int(np.abs(off).max(initial=0)) + 1
    if x.shape[1] * (n * most) ** 2 < 1 << 63:
        d = n * off - rest
        return (d * d).sum(axis=1).tolist()
    rows = [sum((n * o - r) ** 2 for o, r in zip(line, rest.tolist())) for line in off.tolist()]
    return [v if v < 1 << 63 else None for v in rows]


SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)
ROWS = 2_000


def whitened(embeddings: DataFrame, model: dict[int, Whitening], id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row and component, in one pass."""
    shared = embeddings.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, at, x in _by_width(batches, "x"):
            m = model.get(x.shape[1])
            if m is None:
                continue
            ids, k = batch.column("vec_id"), len(m.values)
            for a in range(0, len(at), ROWS):
                part = x[a : a + ROWS]
                r = len(part)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(at[a : a + ROWS], k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)),
                    pa.array(np.full(r * k, m.n)), pa.array(deviations(part, m.n, m.sums), pa.int64()).take(pa.array(np.repeat(np.arange(r), k))),
                    pa.array((centred(part, m.n, m.sums) @ m.weights()).ravel()),
                    pa.array(np.tile(m.values / m.trace, r)), pa.array(np.full(r * k, m.identity_error)),
                ], [c.split()[0] for c in SCHEMA.split(", ")])

    rows = embeddings.select(F.col(id).cast("long").alias("vec_id"), whole_numbers(F.col(vector)).alias("x"))
    return rows.where("size(x) > 0").mapInArrow(run, SCHEMA)
