"""A dense second opinion on the matrix method, for small graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dense_adjacency(edges: list[tuple[int, int, float]], n: int) -> np.ndarray:
    """The symmetrised adjacency, columns divided by their number of entries."""
    w, count = np.zeros((n, n)), np.zeros(n)
    for a, b, x in edges:
        for u, v in ((a, b), (b, a)):
            w[u, v] = max(w[u, v], x)
            count[v] += 1
    return w / np.maximum(count, 1)


def dense_similarity(edges: list[tuple[int, int, float]], n: int, iterations: int, c: float = 0.8) -> np.ndarray:
    """The recurrence of the matrix method from the identity, with all diagonals one."""
    w, s = dense_adjacency(edges, n), np.eye(n)
    for _ in range(iterations):
        s = c * (w.T @ s @ w)
        np.fill_diagonal(s, 1.0)
    return s


def agrees(cells: DataFrame, dense: np.ndarray, tolerance: float = 1e-8) -> bool:
    """Whether cells (absent ones are zero) equal a dense matrix, each within the tolerance. For matrices that fit the driver."""
    got = np.zeros_like(dense)
    for r in cells.collect():
        got[r.i, r.j] = r.score
    return bool((np.abs(got - dense) <= tolerance).all())


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, score, other, difference) of two matrices of any size, cell by cell; absent cells are null, and zero in the difference."""
    both = a.select("i", "j", "score").join(b.select("i", "j", F.col("score").alias("other")), ["i", "j"], "full")
    return both.withColumn("difference", F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("other", F.lit(0.0))))


def max_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(largest absolute difference) of two matrices of any size."""
    return differences(a, b).agg(F.coalesce(F.max("difference"), F.lit(0.0)).alias("difference"))
