"""Sparse tensors as delimited text: three integers a line, comments after # or %."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.schema import Dims

SEPARATORS = {"csv": ",", "ssv": " ", "tsv": "\t"}


def parse(lines: DataFrame, separator: str = "csv", comments: bool = True) -> DataFrame:
    """(i, j, k) of each line of the column value. A line that is not three integers fails the query when it is read."""
    if comments:
        lines = lines.where(~F.col("value").startswith("#") & ~F.col("value").startswith("%"))
    parts = F.split("value", SEPARATORS[separator])
    checked = F.when(F.size(parts) == 3, parts).otherwise(F.raise_error(F.concat(F.lit("not three fields: "), F.col("value"))))
    return lines.select(checked.alias("p")).select(*(F.col("p")[n].cast("long").alias(c) for n, c in enumerate("ijk")))


def to_base0(tensor: DataFrame, base: int) -> DataFrame:
    return tensor.select(*((F.col(c) - base).cast("long").alias(c) for c in "ijk"))


def within(tensor: DataFrame, dims: Dims) -> DataFrame:
    """The tensor, whose reading fails at an index that is null or outside the mode lengths."""
    bad = F.lit(False)
    for c, n in zip("ijk", dims, strict=True):
        bad = bad | F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) >= n)
    return tensor.select(*(F.when(bad, F.raise_error(F.lit("an index is outside the mode lengths"))).otherwise(F.col(c)).alias(c) for c in "ijk"))


def load(spark: SparkSession, path: str, dims: Dims, separator: str = "csv", base: int = 0) -> DataFrame:
    """The distinct nonzeros in a text file, from index 0."""
    return within(to_base0(parse(spark.read.text(path), separator), base), dims).distinct()


def to_lines(rows: DataFrame, columns: list[str], separator: str = "tsv", base: int = 0) -> DataFrame:
    """A column value with the given integer columns, base added."""
    return rows.select(F.concat_ws(SEPARATORS[separator], *((F.col(c) + base).cast("string") for c in columns)).alias("value"))
