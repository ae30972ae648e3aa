"""Forms of Boolean matrices: entries (idx, r), sorted lists by row or column, dense cells, and bit rows (idx, m)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions import bits

#: Columns of which all combinations are listed.
MOST_SUMMED = 20


def transpose(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("r").cast("long").alias("idx"), F.col("idx").cast("long").alias("r"))


def _all(entries: DataFrame, n: int, name: str) -> DataFrame:
    return entries.sparkSession.range(n).select(F.col("id").alias(name))


def rowwise(entries: DataFrame, rows: int) -> DataFrame:
    """(idx, cols): the sorted columns of every row, empty rows included."""
    found = entries.groupBy("idx").agg(F.sort_array(F.collect_set(F.col("r").cast("long"))).alias("c"))
    return _all(entries, rows, "idx").join(found, "idx", "left").select("idx", F.coalesce("c", F.array().cast("array<bigint>")).alias("cols"))


def colwise(entries: DataFrame, columns: int) -> DataFrame:
    """(r, rows): the sorted rows of every column, empty columns included."""
    found = entries.groupBy(F.col("r").cast("long").alias("r")).agg(F.sort_array(F.collect_set(F.col("idx").cast("long"))).alias("c"))
    return _all(entries, columns, "r").join(found, "r", "left").select("r", F.coalesce("c", F.array().cast("array<bigint>")).alias("rows"))


def to_dense(entries: DataFrame, rows: int, columns: int) -> DataFrame:
    """(idx, r, v): every cell. The columns of a row are made by a sequence, so nothing is joined but the entries."""
    cells = _all(entries, rows, "idx").select("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))).alias("r"))
    ones = entries.select(F.col("idx").cast("long"), F.col("r").cast("long"), F.lit(1).alias("one")).distinct()
    return cells.join(ones, ["idx", "r"], "left").select("idx", "r", F.coalesce("one", F.lit(0)).alias("v"))


def from_dense(rows: DataFrame) -> DataFrame:
    """Entries of (idx, values), where values is an array of 0 and 1."""
    return rows.select("idx", F.posexplode("values").alias("r", "v")).where("v <> 0").select("idx", F.col("r").cast("long").alias("r"))


def bit_rows(entries: DataFrame, rows: int) -> DataFrame:
    """(idx, m) of every row."""
    found = entries.groupBy("idx").agg(F.bit_or(bits.bit(F.col("r"))).alias("b"))
    return _all(entries, rows, "idx").join(found, "idx", "left").select("idx", F.coalesce("b", F.lit(0)).cast("long").alias("m"))


def entries_of(masks: DataFrame, rank: int) -> DataFrame:
    return masks.select("idx", F.explode(bits.columns_of(F.col("m"), rank).cast("array<bigint>")).alias("r"))


def unique_columns(entries: DataFrame) -> DataFrame:
    """The number of distinct columns that have entries."""
    columns = entries.groupBy("r").agg(F.sort_array(F.collect_set("idx")).alias("c"))
    return columns.agg(F.count_distinct("c").alias("n"))


def row_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(idx, dist) between two row-wise matrices; a missing row is empty."""
    joined = a.select("idx", F.col("cols").alias("x")).join(b.select("idx", F.col("cols").alias("y")), "idx", "full_outer")
    x, y = (F.coalesce(c, F.array().cast("array<bigint>")) for c in ("x", "y"))
    return joined.select("idx", (F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))).cast("long").alias("dist"))


def row_summations(entries: DataFrame, rank: int) -> DataFrame:
    """(m, rows): for each combination m of columns, the sorted rows that have one of them. There are 2 ** rank of them, so
    ranks over MOST_SUMMED are refused."""
    if rank > MOST_SUMMED:
        raise ValueError(f"rank must be at most {MOST_SUMMED}: {rank}")
    each = entries.sparkSession.range(1 << rank).select(F.col("id").alias("m"), F.explode(bits.columns_of(F.col("id"), rank)).alias("r"))
    found = each.join(entries.select(F.col("r").cast("int").alias("r"), "idx"), "r")
    return found.groupBy("m").agg(F.sort_array(F.collect_set("idx")).alias("rows"))


def merged(rows: DataFrame) -> DataFrame:
    """(key, cols): the union of the lists of each key."""
    return rows.select("key", F.explode("cols").alias("c")).groupBy("key").agg(F.sort_array(F.collect_set("c")).alias("cols"))
