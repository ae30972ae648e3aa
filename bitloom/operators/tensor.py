"""Operators over sparse tensors (i, j, k)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.schema import Dims

CELL = ["i", "j", "k"]
#: For each mode: its column, then the other two, the slow one (matrix 1) first.
MODES = {1: ("i", "k", "j"), 2: ("j", "k", "i"), 3: ("k", "j", "i")}


def length(dims: Dims, column: str) -> int:
    return dict(zip("ijk", dims, strict=True))[column]


def unfold(tensor: DataFrame, dims: Dims, mode: int) -> DataFrame:
    """(row, col): col runs over the fast mode first."""
    row, slow, fast = MODES[mode]
    return tensor.select(F.col(row).cast("long").alias("row"), (F.col(fast).cast("long") + F.col(slow).cast("long") * length(dims, fast)).alias("col"))


def slice_counts(tensor: DataFrame, mode: int) -> DataFrame:
    return tensor.groupBy(F.col(MODES[mode][0]).alias("idx")).agg(F.count("*").alias("cnt"))


def row_pieces(unfolded: DataFrame, fast: int) -> DataFrame:
    """(block, row, cols): for each block of fast columns, the sorted places within it of each row that has some."""
    piece = unfolded.groupBy(F.floor(F.col("col") / fast).cast("long").alias("block"), "row")
    return piece.agg(F.sort_array(F.collect_list((F.col("col") % fast).cast("long"))).alias("cols"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(abs_diff, sq_diff, only_a, only_b, both): cells in which two tensors differ, and agree."""
    side = lambda t, c: t.select(*CELL, F.lit(1).alias(c))
    va, vb = F.coalesce("va", F.lit(0)), F.coalesce("vb", F.lit(0))
    both = side(a, "va").join(side(b, "vb"), CELL, "full_outer").select(va.alias("a"), vb.alias("b"))
    return both.agg(
        F.coalesce(F.sum(F.abs(F.col("a") - F.col("b"))), F.lit(0)).cast("long").alias("abs_diff"),
        F.coalesce(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))), F.lit(0)).cast("long").alias("sq_diff"),
        F.count_if(F.expr("a > b")).alias("only_a"),
        F.count_if(F.expr("a < b")).alias("only_b"),
        F.count_if(F.expr("a = b")).alias("both"),
    )


def semi(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, CELL, "left_semi")


def anti(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, CELL, "left_anti")
