"""Near-equal contiguous ranges, in exact integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def split(spark: SparkSession, start: int, end: int, parts: int) -> DataFrame:
    """(part, lo, hi): start to end, both included, in parts ranges."""
    n = end - start + 1
    if not 1 <= parts <= n:
        raise ValueError(f"{n} indices cannot be split into {parts} ranges")
    lo = lambda p: (F.lit(start) + F.floor(p * n / F.lit(parts))).cast("long")
    return spark.range(parts).select(F.col("id").alias("part"), lo(F.col("id")).alias("lo"), (lo(F.col("id") + 1) - 1).alias("hi"))


def split_by_size(spark: SparkSession, start: int, end: int, most: int) -> DataFrame:
    """As few near-equal ranges as have at most most indices each."""
    return split(spark, start, end, -(-(end - start + 1) // most))


def part_of(index: Column, total: int, parts: int) -> Column:
    """The range of an index from 0, when 0 to total - 1 is split into parts."""
    return (F.floor(((index + 1) * parts + (total - 1)) / F.lit(total)) - 1).cast("long")


def column_blocks(unfolded: DataFrame, slow: int, fast: int, parts: int) -> DataFrame:
    """(row, col, part, block, place): the range of each column, and where it lies in its block of fast columns."""
    return unfolded.select("row", "col", part_of(F.col("col"), slow * fast, parts).alias("part"), F.floor(F.col("col") / fast).cast("long").alias("block"), (F.col("col") % fast).alias("place"))


def balanced(counts: DataFrame, parts: int) -> DataFrame:
    """(part, lo, hi, cnt): ranges of indices with near-equal counts, from (idx, cnt).

    A range ends at the first index with which it reaches what is left divided by the ranges that are left, rounded
    down. The cuts depend on each other, so a walk over the counts, streamed in order, makes them; memory is constant.
    """
    total = counts.agg(F.sum("cnt")).first()[0] or 0
    target, held, done, low, out = total // parts, 0, 0, 0, []
    for idx, cnt in counts.select("idx", "cnt").orderBy("idx").toLocalIterator():
        held += cnt
        if held >= target:
            out.append((len(out), low, idx, held))
            done, held, low = done + held, 0, idx + 1
            if len(out) < parts:
                target = (total - done) // (parts - len(out))
    return counts.sparkSession.createDataFrame(out, "part long, lo long, hi long, cnt long")
