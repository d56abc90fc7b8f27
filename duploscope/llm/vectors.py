"""Embedding columns as whole numbers, and exact squared distances between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUND = 1 << 27  # components stay below it, so that a squared distance of up to 128 of them fits into a long


def as_doubles(vector: str) -> Column:
    return F.col(vector).cast("array<double>")


def is_whole(vector: Column, scale: int) -> Column:
    """Whether a vector of doubles is there, no component is null or not finite, and all are below BOUND when scaled."""
    fits = F.forall(vector, lambda x: x.isNotNull() & F.coalesce(F.abs(x) < F.lit(float(BOUND // scale)), F.lit(False)))
    return F.coalesce(vector.isNotNull() & fits, F.lit(False))


def scaled(column: pa.Array, scale: int, dims: int) -> np.ndarray:
    """floor(scale * x) of the vectors of a batch, which `is_whole` accepts and which have `dims` components."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return np.floor(values * scale).astype(np.int64).reshape(len(column), dims)


def first_vectors(rows: DataFrame, order: list[Column], count: int, scale: int) -> np.ndarray:
    """The first `count` vectors of (vector, ...) in order, scaled; equal places are decided by the components."""
    found = rows.orderBy(*order, "vector").limit(count).select("vector").collect()
    return np.array([np.floor(np.array(row.vector, np.float64) * scale) for row in found], np.int64)


def squared_distances(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector to each entry."""
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
    if 4 * largest * largest * vectors.shape[1] < 1 << 53:  # doubles hold every sum without rounding
        left, right = vectors.astype(np.float64), entries.astype(np.float64)
        apart = (left * left).sum(axis=1)[:, None] + (right * right).sum(axis=1)[None, :] - 2 * (left @ right.T)
        return apart.astype(np.int64)
    return np.stack([((vectors - entry) ** 2).sum(axis=1) for entry in entries], axis=1)


def packed(vectors: np.ndarray) -> list[bytes]:
    """Each row as little-endian 32-bit numbers."""
    return [row.tobytes() for row in vectors.astype("<i4")]


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """Rows of `width` numbers from a column of `packed` ones."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, "<i4").astype(np.int64).reshape(-1, width)
