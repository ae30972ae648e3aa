"""Random sparse tensors and factors by seeded draws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions.select import cut, kth


#: Rows up to which the first ones are taken by a bounded heap of a task; more are told by a threshold.
SORTED = 100_000


def _first(drawn: DataFrame, n: int) -> DataFrame:
    """(cell): the n rows of (cell, place) that come first by place and then by cell."""
    if n <= SORTED:
        return drawn.orderBy("place", "cell").limit(n).select("cell")
    drawn = cut(drawn)
    place, below = kth(drawn, "place", n)
    cell, _ = kth(drawn.where(F.col("place") == place), "cell", n - below)
    return drawn.where((F.col("place") < place) | ((F.col("place") == place) & (F.col("cell") <= cell))).select("cell")


def cells(spark: SparkSession, lengths: tuple[int, ...], density: float, seed: int) -> DataFrame:
    """(c0, c1, ...): floor(density * number of cells) distinct cells; none for a density of 0.

    Sparse tensors are drawn: over twice as many numbers as cells wanted, of which the first distinct ones count. Dense ones rank all
    cells by a hash.
    """
    total = reduce(lambda a, b: a * b, lengths, 1)
    n = int(density * total)
    if 4 * n >= total:
        found = _first(spark.range(total).select(F.xxhash64(F.lit(seed).cast("long"), "id").alias("place"), F.col("id").alias("cell")), n)
    else:
        drawn = spark.range(2 * n + 64).select("id", F.pmod(F.xxhash64(F.lit(seed).cast("long"), "id"), F.lit(total).cast("long")).alias("cell"))
        found = _first(drawn.groupBy("cell").agg(F.min("id").alias("place")), n)
    out, size = [], total
    for k, m in enumerate(lengths):
        size //= m
        out.append((F.floor(F.col("cell") / size) % m).cast("long").alias(f"c{k}"))
    return found.select(*out)


def factor(spark: SparkSession, rows: int, rank: int, density: float, seed: int) -> DataFrame:
    """Entries (idx, r)."""
    return cells(spark, (rows, rank), density, seed).toDF("idx", "r")


def core(spark: SparkSession, ranks: tuple[int, int, int], density: float, seed: int) -> DataFrame:
    found = cells(spark, ranks, density, seed)
    return found.select(*(F.col(f"c{k}").cast("int").alias(f"r{k + 1}") for k in range(3)))
