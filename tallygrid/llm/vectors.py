"""Vectors as integers: exact distances, roots and centroids shared by the vector operators.

Components are bounded by BOUND, so that four times a squared distance over MOST_DIMS of them stays below 2**63. A larger one fails the
job by name, as no result over it could be exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BOUND, MOST_DIMS = 1 << 25, 512
_EXACT = 1 << 53


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null or not finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * component), components taken as doubles."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    inside = F.forall(whole, lambda x: (x > -BOUND) & (x < BOUND))
    return F.when(inside, whole).otherwise(F.raise_error(F.lit(f"a vector component times {scale} is not within {BOUND}"))).cast("array<int>")


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A column of lists, `dims` numbers each, as rows of 64-bit integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def lists(rows: np.ndarray) -> pa.Array:
    """The inverse of matrix, as 32-bit integers."""
    n, dims = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * dims + 1, dims) if dims else np.zeros(n + 1), pa.int32()), pa.array(rows.reshape(-1), pa.int32()))


def row_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to the same row of y, or to y itself."""
    apart = x - y
    return np.einsum("ij,ij->i", apart, apart)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to the few rows of y: by a product of doubles where these hold every sum exactly."""
    most = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    if x.shape[1] * (2 * int(most)) ** 2 >= _EXACT:
        return np.stack([row_distances(x, c) for c in y], axis=1)
    a, b = x.astype(np.float64), y.astype(np.float64)
    return (np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)).astype(np.int64)


def root_below(square: np.ndarray) -> np.ndarray:
    """The whole part of the square root of 64-bit integers, exactly."""
    root = np.sqrt(square.astype(np.float64)).astype(np.int64)
    root -= root * root > square
    return root + ((root + 1) * (root + 1) <= square)


def root_above(square: np.ndarray) -> np.ndarray:
    """The square root rounded up."""
    root = root_below(square)
    return root + (root * root < square)


def means(now: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Centroids after a round: floor(sum / count) where there is a count, unchanged elsewhere. Python's integers, so no sum is rounded."""
    out = now.copy()
    for k, (count, total) in sums.items():
        out[k] = [t // count for t in total]
    return out
