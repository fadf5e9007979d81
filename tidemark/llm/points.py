"""Vectors as points with integer components, and exact squared distances between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are held at most so far from 0, so that a squared distance fits a long; what lies beyond counts as this far.
LIMIT = 1 << 26
#: Up to this size of components, sums of products in double are whole and exact.
EXACT = 1 << 21


def whole(vector: str) -> Column:
    """True where a vector is there and none of its components is null or not finite."""
    return F.coalesce(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def grid(vector: str, scale: int) -> Column:
    """Each component x as floor(scale * x), computed in double."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))


def with_points(vectors: DataFrame, vector: str, scale: int, size: int, kept: list[Column]) -> DataFrame:
    """`kept` and point of the vectors of `size` components that are all there."""
    return vectors.where(whole(vector) & (F.size(vector) == size)).select(*kept, grid(vector, scale).alias("point"))


def matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all rows of c, exact."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) * max(1, x.shape[1]) ** 0.5 <= EXACT * 8:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return np.rint((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, row in enumerate(c):
        d = x - row
        out[:, j] = (d * d).sum(1)
    return out


def floors(sums: np.ndarray, counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Means, rounded down, of groups that have members; what was before for the others."""
    return np.where((counts > 0)[:, None], sums // np.maximum(counts, 1)[:, None], before)


def joined(rows: np.ndarray) -> str:
    return ",".join(map(str, rows.ravel().tolist()))
