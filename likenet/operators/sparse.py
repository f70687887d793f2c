"""Products of sparse matrices in long form (i, j, score), as an equi-join and a sum.

A product of three is taken in two steps: Catalyst combines before the first shuffle, and the rows of a step grow with
the sum of degrees, not with their product. No side is broadcast by hand: Spark does that where its size estimate allows,
and splits joins that turn out skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def product_left(adjacency: DataFrame, cells: DataFrame, transpose: bool) -> DataFrame:
    """W·S, or its transpose Wᵀ·S: (i, j, score)."""
    meet, stay = ("u", "v") if transpose else ("v", "u")
    w = adjacency.select(F.col(meet).alias("meet"), F.col(stay).alias("out"), F.col("w").alias("factor"))
    joined = cells.join(w, F.col("i") == F.col("meet"))
    return joined.groupBy(F.col("out").alias("i"), "j").agg(F.sum(F.col("factor") * F.col("score")).alias("score"))


def product_right(cells: DataFrame, adjacency: DataFrame, transpose: bool) -> DataFrame:
    """S·W, or S·Wᵀ if ``transpose``: (i, j, score)."""
    meet, stay = ("v", "u") if transpose else ("u", "v")
    w = adjacency.select(F.col(meet).alias("meet"), F.col(stay).alias("out"), F.col("w").alias("factor"))
    joined = cells.join(w, F.col("j") == F.col("meet"))
    return joined.groupBy("i", F.col("out").alias("j")).agg(F.sum(F.col("score") * F.col("factor")).alias("score"))


def nonzero(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("score") != 0)


def across_sides(cells: DataFrame, n_a: int) -> DataFrame:
    """Cells whose row and column lie on different sides, zeros dropped."""
    return nonzero(cells.where((F.col("i") < n_a) != (F.col("j") < n_a)))


def within_sides(cells: DataFrame, n_a: int) -> DataFrame:
    """Cells whose row and column lie on one side, zeros dropped."""
    return nonzero(cells.where((F.col("i") < n_a) == (F.col("j") < n_a)))


def left_product(cells: DataFrame, adjacency: DataFrame, n_a: int) -> DataFrame:
    """Wᵀ·S, cells across sides only."""
    return across_sides(product_left(adjacency, cells, transpose=True), n_a)


def right_product(cells: DataFrame, adjacency: DataFrame, n_a: int, c: float) -> DataFrame:
    """c·(M·W), cells within sides only, with ones on the diagonal; the result is stored transposed."""
    out = within_sides(product_right(cells, adjacency, transpose=False), n_a)
    score = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.lit(c) * F.col("score"))
    return out.select(F.col("j").alias("i"), F.col("i").alias("j"), score.alias("score"))


def expand_pairs(cells: DataFrame, adjacency: DataFrame, c: float) -> DataFrame:
    """striu(c·W·X·Wᵀ): what the pairs of neighbours of each cell receive, targets i < j only."""
    out = product_right(product_left(adjacency, nonzero(cells), transpose=False), adjacency, transpose=True)
    return out.where("i < j").withColumn("score", F.lit(c) * F.col("score"))


def doubled(cells: DataFrame) -> DataFrame:
    """Off-diagonal cells count twice: only the upper triangle is stored."""
    return cells.withColumn("score", F.when(F.col("i") != F.col("j"), 2.0).otherwise(1.0) * F.col("score"))


def accumulate(cells: DataFrame, delta: DataFrame) -> DataFrame:
    """S + Δ on the keys of S; keys of Δ alone are lost."""
    d = delta.select(F.col("i").alias("di"), F.col("j").alias("dj"), F.col("score").alias("d"))
    joined = cells.join(d, (F.col("i") == F.col("di")) & (F.col("j") == F.col("dj")), "left")
    return joined.select("i", "j", (F.col("score") + F.coalesce("d", F.lit(0.0))).alias("score"))


def over_threshold(delta: DataFrame, epsilon: float) -> DataFrame:
    """Off-diagonal cells strictly over epsilon."""
    return delta.where((F.col("i") != F.col("j")) & (F.col("score") > epsilon))


def pack_columns(cells: DataFrame) -> DataFrame:
    """(j, cells): the entries of each column in one array, by row."""
    return cells.groupBy("j").agg(F.sort_array(F.collect_list(F.struct("i", "score"))).alias("cells"))


def unpack_columns(columns: DataFrame) -> DataFrame:
    return columns.select("j", F.explode("cells").alias("c")).select("c.i", "j", "c.score")
