"""Tables built from the edges (src, dst, w) of a bipartite graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symmetrised(edges: DataFrame) -> DataFrame:
    """(u, v, w): every edge in both directions, repeated edges kept."""
    return edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), "w").unionAll(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "w"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(v, n): a row for each neighbour, repeated edges kept; of A's vertices and of B's."""
    return edges.select(F.col("src").alias("v"), F.col("dst").alias("n")).unionAll(edges.select(F.col("dst").alias("v"), F.col("src").alias("n")))


def degrees(edges: DataFrame) -> DataFrame:
    """(v, d): entries per vertex, repeated edges counted."""
    return neighbours(edges).groupBy("v").agg(F.count(F.lit(1)).alias("d"))


def normalised(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """(u, v, w): the symmetrised adjacency, each column divided by its number of entries.

    Weighted, a repeated edge counts in the number but is one cell (of differing weights, the greatest). Otherwise weights count as
    one and a repeated edge adds up.
    """
    both = symmetrised(edges)
    # The number of entries comes by a join, not by a window: a vertex with very many edges is then counted in parts, and its join split.
    cells = both.groupBy("u", "v").agg((F.max("w") if weighted else F.count(F.lit(1)).cast("double")).alias("x"))
    return cells.join(degrees(edges), "v").select("u", "v", (F.col("x") / F.col("d")).alias("w"))


def transposed(cells: DataFrame) -> DataFrame:
    """Rows and columns of the first two columns swapped."""
    i, j, value = cells.columns[:3]
    return cells.select(F.col(j).alias(i), F.col(i).alias(j), value)


def row_slices(cells: DataFrame, slices: int) -> DataFrame:
    """With the number of the slice that a row belongs to."""
    if slices < 2:
        raise ValueError("slices must be over 1")
    return cells.withColumn("slice", F.pmod(F.col(cells.columns[0]), F.lit(slices)).cast("int"))


def check_sides(cells: DataFrame, n_a: int) -> DataFrame:
    """The cells; one whose ends lie on different sides is an error when it is computed."""
    same = (F.col("i") < n_a) == (F.col("j") < n_a)
    return cells.withColumn("i", F.when(same, F.col("i")).otherwise(F.raise_error(F.lit("a pair across sides is impossible"))))
