"""Tables without lineage, and the k-th value of a column without sorting its rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a value that one pass settles: at most 2 ** BITS + 1 counts reach the driver.
BITS = 12


def cut(df: DataFrame) -> DataFrame:
    """df without lineage, in the shared checkpoint folder; only in local mode a temporary one may stand in for it."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bitloom-"))
    return df.checkpoint()


def kth(df: DataFrame, column: str, k: int) -> tuple[int, int]:
    """The k-th smallest value (from 1) of a long column without nulls, and how many rows lie below it.

    Each pass counts rows by their leading bits, with map-side aggregation, and goes on inside the group that holds the k-th;
    df is read once a pass. k is at most the number of rows.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    shift, below = max(0, (high - low).bit_length() - BITS), 0
    while True:
        counts = df.groupBy(F.shiftright(F.col(column), shift).alias("b")).agg(F.count("*").alias("n")).collect()
        for b, n in sorted(counts):
            if below + n >= k:
                break
            below += n
        if not shift:
            return b, below
        df, shift = df.where(F.shiftright(F.col(column), shift) == b), max(0, shift - BITS)
