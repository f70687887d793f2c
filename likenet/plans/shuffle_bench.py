"""Two shuffles of the same records by the same key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(spark: SparkSession, size: int) -> DataFrame:
    """size * size records (r, i, v)."""
    pairs = spark.range(size * size)
    return pairs.select(F.floor(F.col("id") / size).cast("int").alias("r"), (F.col("id") % size).cast("int").alias("i"), F.lit(1.0).alias("v"))


def double_shuffle(rows: DataFrame, partitions: int, key: str = "r") -> DataFrame:
    """Rows dealt by key, and once more over another number of partitions, which Spark can't leave out."""
    return rows.repartition(partitions, key).repartition(partitions + 1, key)
