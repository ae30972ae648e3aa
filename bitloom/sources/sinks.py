"""Factors and cores as text files, named as <prefix>_factor<n>_dense.txt and so on."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions import bits
from bitloom.sources.text import to_lines


def prefix_of(path: str) -> str:
    """The file name without its extension; a name without a dot stays whole."""
    return PurePosixPath(path).stem or PurePosixPath(path).name


def dense_lines(masks: DataFrame, rank: int) -> DataFrame:
    """(idx, value): a string of '0' and '1' for each row."""
    return masks.select("idx", bits.bit_string(F.col("m"), rank).alias("value"))


def write_factor(masks: DataFrame, rank: int, folder: str, prefix: str, n: int, base: int = 0) -> None:
    dense_lines(masks, rank).orderBy("idx").select("value").write.mode("overwrite").text(f"{folder}/{prefix}_factor{n}_dense.txt")
    entries = masks.select("idx", F.explode(bits.columns_of(F.col("m"), rank)).alias("r"))
    to_lines(entries.orderBy("idx", "r"), ["idx", "r"], base=base).write.mode("overwrite").text(f"{folder}/{prefix}_factor{n}_sparse.txt")


def write_core(core: DataFrame, folder: str, prefix: str, base: int = 0) -> None:
    to_lines(core.orderBy("r1", "r2", "r3"), ["r1", "r2", "r3"], base=base).write.mode("overwrite").text(f"{folder}/{prefix}_core_tensor.txt")


def write_summary(spark, folder: str, name: str, error: int | None, seconds: float, factor_seconds: float, core_seconds: float) -> None:
    """A line is appended: error, seconds in total, for the factors and for the core."""
    line = "\t".join(("" if error is None else str(error), f"{seconds:.3f}", f"{factor_seconds:.3f}", f"{core_seconds:.3f}"))
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{folder}/{name}.result")


def write_log(spark, folder: str, prefix: str, lines: list[str]) -> None:
    """One file <prefix>.log of the given lines, in any file system that Spark can write to."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}.log")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray("".join(f"{line}\n" for line in lines).encode()))
    finally:
        out.close()
