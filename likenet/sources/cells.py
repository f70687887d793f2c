"""Matrix cells as text: one ``((row,col),value)`` per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the line format. No signs, no exponent, digits on both sides of the point.
CELL = r"^\(\(([0-9]+),([0-9]+)\),([0-9]+\.[0-9]+)\)$"


def parse_cells(lines: DataFrame, names: tuple[str, str, str] = ("i", "j", "score"), strict: bool = True) -> DataFrame:
    """Cells from a column ``value`` of lines. In strict mode a line of another form is an error, otherwise it is left out."""
    good = F.col("value").rlike(CELL)
    if strict:
        checked = F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a cell: "), F.coalesce("value", F.lit("null")))))
    else:
        lines, checked = lines.where(good), F.col("value")
    part = lambda k, kind: F.regexp_extract(checked, CELL, k).cast(kind)
    return lines.select(part(1, "int").alias(names[0]), part(2, "int").alias(names[1]), part(3, "double").alias(names[2]))


def read_cells(spark: SparkSession, path: str, **how) -> DataFrame:
    return parse_cells(spark.read.text(path), **how)


def read_graph(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Edges (src, dst, w)."""
    return read_cells(spark, path, names=("src", "dst", "w"), strict=strict)


def format_cells(cells: DataFrame) -> DataFrame:
    """Lines that ``parse_cells`` reads back: values with twelve digits, never with an exponent."""
    i, j, value = cells.columns[:3]
    return cells.select(F.format_string("((%d,%d),%s)", i, j, F.col(value).cast("decimal(38,12)").cast("string")).alias("value"))


def write_cells(cells: DataFrame, path: str) -> None:
    format_cells(cells).write.text(path)


def discard_rows(df: DataFrame) -> None:
    """Compute every row and keep none."""
    df.write.format("noop").mode("overwrite").save()
