"""Checks on embedding columns, and k-means, shared by the operators on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(col: str) -> Column:
    """Whether an array of numbers is there, has components, and all of them are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(col).isNotNull() & (F.size(col) > 0) & ~F.coalesce(F.exists(col, bad), F.lit(True))


def usual_length(rows: DataFrame, col: str) -> int:
    """The commonest length of an array column, the smaller of equally common ones; 0 for an empty table."""
    got = rows.groupBy(F.size(col).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return got["n"] if got else 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest center of each row, and the squared distances to all centers."""
    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)[None, :], 0)
    return d.argmin(1), d


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """At most ``k`` centers by Lloyd's method from distinct random rows; a center that loses all rows is dropped."""
    rows = np.unique(x, axis=0)
    centers = rows[np.random.default_rng(seed).permutation(len(rows))[:k]]
    for _ in range(rounds):
        at, _ = nearest(x, centers)
        n = np.bincount(at, minlength=len(centers))
        sums = np.stack([np.bincount(at, column, len(centers)) for column in x.T], axis=1)
        centers = sums[n > 0] / n[n > 0, None]
    return centers
