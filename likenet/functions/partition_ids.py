"""Partition numbers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def modulo(key: Column, partitions: int) -> Column:
    return F.pmod(key, F.lit(partitions)).cast("int")


def sub_modulo(key: Column, partitions: int, sub_partitions: int) -> Column:
    """Keys that differ in the last ``sub_partitions`` only go to one partition."""
    return F.pmod(F.floor(key / F.lit(sub_partitions)), F.lit(partitions)).cast("int")
