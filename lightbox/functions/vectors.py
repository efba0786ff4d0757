"""Vector columns: Arrow functions over whole batches.

Spark has no vector distance of its own, and higher-order functions visit one
element at a time. These work on the flat value buffer of the list column, so a
batch costs one numpy call. Everything is computed in double precision.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Score of a vector whose length differs from the model's.
MISMATCH = -999.0


def to_matrix(col: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(n x dim matrix, mask of usable rows); null or odd-length rows become zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    lengths = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    if dim is None:
        dim = int(lengths.max()) if n else 0
    usable = (lengths == dim) & (dim > 0)
    if usable.all():
        return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dim), usable
    out = np.zeros((n, dim))
    kept = col.filter(pa.array(usable))
    if len(kept):
        out[usable] = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return out, usable


def from_matrix(matrix: np.ndarray, usable: np.ndarray | None = None, kind=pa.float64()) -> pa.Array:
    n, dim = matrix.shape
    values = pa.array(np.ascontiguousarray(matrix).reshape(-1), kind)
    out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), values)
    if usable is None or usable.all():
        return out
    return pc.if_else(pa.array(usable), out, pa.nulls(n, out.type))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    norm = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(norm > 0, norm, 1.0)[:, None]


def l2_normalize(vector: Column) -> Column:
    @F.arrow_udf("array<double>")
    def normalize(v: pa.Array) -> pa.Array:
        return _ragged(v, lambda m: unit_rows(m))

    return normalize(vector)


def _ragged(v: pa.Array, fn) -> pa.Array:
    """Apply ``fn`` to the matrix of each vector length found in the batch."""
    lengths = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
    sizes = np.unique(lengths)
    if len(sizes) == 1 and sizes[0] > 0:
        return from_matrix(fn(to_matrix(v)[0]))
    out: list = [None] * len(v)
    for size in sizes:
        at = np.flatnonzero(lengths == size)
        if size == 0:
            for i in at:
                out[i] = []
        elif size > 0:
            part = fn(to_matrix(v.take(pa.array(at)))[0])
            for i, row in zip(at, part):
                out[i] = row.tolist()
    return pa.array(out, pa.list_(pa.float64()))


def is_zero(vector: Column) -> Column:
    """No element differs from zero; such vectors have no direction and join nothing."""
    return ~F.exists(vector, lambda x: x != 0)


def paired(x: pa.Array, y: pa.Array, fn) -> pa.Array:
    """``fn`` of two matrices for the rows whose lengths agree; null elsewhere and where it is nan."""
    lx, ly = (pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False) for v in (x, y))
    out = np.full(len(x), np.nan)
    for size in np.unique(lx[(lx == ly) & (lx > 0)]):
        at = np.flatnonzero((lx == size) & (ly == size))
        take = pa.array(at)
        out[at] = fn(to_matrix(x.take(take))[0], to_matrix(y.take(take))[0])
    return pa.array(out, mask=np.isnan(out))


def row_dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y)


def dot(a: Column, b: Column) -> Column:
    @F.arrow_udf("double")
    def product(x: pa.Array, y: pa.Array) -> pa.Array:
        return paired(x, y, row_dots)

    return product(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine; null when either vector is zero or lengths differ."""

    def angle(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        directed = x.any(axis=1) & y.any(axis=1)
        far = np.maximum(1.0 - row_dots(unit_rows(x), unit_rows(y)), 0.0)
        return np.where(directed, far, np.nan)

    @F.arrow_udf("double")
    def distance(x: pa.Array, y: pa.Array) -> pa.Array:
        return paired(x, y, angle)

    return distance(a, b)


def distance_to(vector: Column, query: np.ndarray) -> Column:
    """Cosine distance to one fixed query vector."""
    q = unit_rows(np.asarray(query, np.float64)[None, :])[0]

    @F.arrow_udf("double")
    def distance(x: pa.Array) -> pa.Array:
        m, ok = to_matrix(x, len(q))
        return pa.array(np.maximum(1.0 - unit_rows(m) @ q, 0.0), mask=~(ok & m.any(axis=1) & q.any()))

    return distance(vector)


def _as_bytes(x: pa.Array, dtype=None) -> pa.Array:
    """The values of each list as bytes: one buffer of all values, cut at the list borders."""
    valid = x.is_valid()
    lengths = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
    values = np.ascontiguousarray(x.flatten().to_numpy(zero_copy_only=False), dtype or x.type.value_type.to_pandas_dtype())
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]) * values.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(x), [pc.and_(valid, valid).buffers()[1], pa.py_buffer(ends), pa.py_buffer(values)]
    ).cast(pa.binary())


def _as_lists(x: pa.Array, dtype) -> pa.Array:
    """The lists that :func:`_as_bytes` wrote, over the batch's one data buffer."""
    step = np.dtype(dtype).itemsize
    sizes = pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    odd = np.flatnonzero(sizes % step)
    if len(odd):
        raise ValueError(f"vector of {sizes[odd[0]]} bytes is not a multiple of {step}")
    kept = pa.concat_arrays([x.drop_null().cast(pa.large_binary())])
    if len(kept):
        borders = np.frombuffer(kept.buffers()[1], np.int64)[kept.offset : kept.offset + len(kept) + 1]
        data = np.frombuffer(kept.buffers()[2] or b"", np.uint8)[borders[0] : borders[-1]]
    else:
        data = np.empty(0, np.uint8)
    ends = np.concatenate([[0], np.cumsum(sizes // step)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(data.tobytes(), dtype)), mask=pc.is_null(x))


def fingerprint(vector: Column) -> Column:
    """Digest of the exact stored values, a short key for equal vectors."""

    @F.arrow_udf("binary")
    def raw(x: pa.Array) -> pa.Array:
        return _as_bytes(x)

    return F.unhex(F.sha2(raw(vector), 256))


def decode_vectors(raw: Column, double: bool = False) -> Column:
    """Native-endian bytes to an array; a length that does not divide is an error."""
    dtype, kind = (np.float64, "double") if double else (np.float32, "float")

    @F.arrow_udf(f"array<{kind}>")
    def decode(x: pa.Array) -> pa.Array:
        return _as_lists(x, dtype)

    return decode(raw)


def encode_vectors(vector: Column, double: bool = False) -> Column:
    dtype = np.float64 if double else np.float32

    @F.arrow_udf("binary")
    def encode(x: pa.Array) -> pa.Array:
        return _as_bytes(x, dtype)

    return encode(vector)
