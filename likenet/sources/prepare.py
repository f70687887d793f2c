"""What a run starts from: initial similarity, identity, random graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cells import write_cells


def init_similarity(spark: SparkSession, n_a: int, n_b: int) -> DataFrame:
    """(i, j, score) for i <= j on the same side: 1.0 on the diagonal, explicit 0.0 beside it."""
    side_end = F.when(F.col("id") < n_a, F.lit(n_a - 1)).otherwise(F.lit(n_a + n_b - 1)).cast("long")
    cells = spark.range(n_a + n_b).select(F.col("id").alias("i"), F.explode(F.sequence("id", side_end)).alias("j"))
    return cells.select(F.col("i").cast("int"), F.col("j").cast("int"), F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0).alias("score"))


def identity(spark: SparkSession, n: int) -> DataFrame:
    """(i, i, 1.0) for i < n."""
    return spark.range(n).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.lit(1.0).alias("score"))


def prepare(spark: SparkSession, n_a: int, n_b: int, similarity_path: str, identity_path: str) -> None:
    """Write both matrices as text."""
    write_cells(init_similarity(spark, n_a, n_b), similarity_path)
    write_cells(identity(spark, n_a + n_b), identity_path)


def random_bipartite(spark: SparkSession, n_a: int, n_b: int, draws: int, seed: int = 0, dist: str = "uniform", exponent: float = 1.5) -> DataFrame:
    """Distinct random edges (src, dst, w = 1.0) from A ids [0, n_a) to B ids [n_a, n_a + n_b), of so many draws.

    The numbers are parts of a hash of seed and draw, so that a draw is the same wherever it is computed, and again after an executor is lost.
    ``dist="zipf"`` draws A ends of rank r in proportion to about r ** -exponent, by inversion.
    """
    if n_a < 1 or n_b < 1:
        raise ValueError("both sides need vertices")
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    u, v = (F.conv(F.substring(drawn, k, 8), 16, 10).cast("double") / float(1 << 32) for k in (1, 9))
    if dist == "zipf":
        rest = 1 - exponent
        u = (F.pow(F.lit(1.0) + u * ((n_a + 1.0) ** rest - 1.0), F.lit(1.0 / rest)) - 1.0) / n_a
    elif dist != "uniform":
        raise ValueError("dist must be uniform or zipf")
    ends = spark.range(draws).select(
        F.least(F.floor(u * n_a), F.lit(n_a - 1)).cast("int").alias("src"), (F.floor(v * n_b) + n_a).cast("int").alias("dst")
    )
    return ends.distinct().withColumn("w", F.lit(1.0))
