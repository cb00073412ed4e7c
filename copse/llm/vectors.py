"""Vector columns as matrices, and the best few of a block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str = "embedding") -> Column:
    """Vectors that are not null and hold only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as float64 rows of `dims`, zeros after the end of shorter lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(n) and (n == dims).all():
        return flat.reshape(len(n), dims)
    out = np.zeros((len(n), dims))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def binary(rows: np.ndarray) -> pa.Array:
    data, step = np.ascontiguousarray(rows).tobytes(), rows.shape[1] * rows.itemsize
    return pa.array([data[i * step : (i + 1) * step] for i in range(len(rows))], type=pa.binary())


def from_binary(column: pa.Array, dtype, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), dims)


def grouped(x: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(centres, group of each row) of a bounded number of rows: k-means from rows far from each other, at most `k` groups, none empty."""
    at = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(at) < min(k, len(x)) and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
    centres = x[at].copy()
    for _ in range(rounds):
        group = ((centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
        for g in np.unique(group):
            centres[g] = x[group == g].mean(0)
    used, group = np.unique(((centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(1), return_inverse=True)
    return centres[used], group


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each row of `scores`, the columns of the k highest, ties to smaller ids, in that order."""
    order = np.argsort(ids, kind="stable")
    s = scores[:, order]
    k = min(k, s.shape[1])
    if k < s.shape[1]:
        edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        out = np.empty((len(s), k), dtype=np.int64)
        for i in range(len(s)):
            c = np.flatnonzero(s[i] >= edge[i])
            out[i] = c[np.argsort(-s[i][c], kind="stable")[:k]]
        return order[out]
    return order[np.argsort(-s, axis=1, kind="stable")]


def block_rows(rows: int, dims: int, most: int = 16_384, memory: int = 32 << 20) -> int:
    """Rows of a block: so many that rows are copied seldom (once for each block of the other side), but a 64th of few rows, and no more than `memory` bytes in double precision."""
    return max(64, min(most, max(1024, rows // 64), memory // (8 * dims)))
