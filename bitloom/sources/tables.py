"""Tensors derived from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.schema import Dims

SUPPLY, EVENTS = Dims(30, 40, 50), Dims(40, 5, 24)


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by parts by months with large orders."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 45")
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return rows.select((F.col("l_suppkey") % 30).cast("long").alias("i"), (F.col("l_partkey") % 40).cast("long").alias("j"), (month % 50).cast("long").alias("k")).distinct()


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by parts by months since January 1990, of all line items and not folded: the lengths grow with the tables."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    month = (F.year("l_shipdate") - 1990) * 12 + F.month("l_shipdate") - 1
    return rows.select(F.col("l_suppkey").cast("long").alias("i"), F.col("l_partkey").cast("long").alias("j"), month.cast("long").alias("k")).distinct()


def wide_dims(spark: SparkSession, sf_dir: str) -> Dims:
    """The lengths of the wide tensor, by its last supplier, part and month."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    last = rows.agg(F.max("l_suppkey").alias("i"), F.max("l_partkey").alias("j"), F.max("l_shipdate").alias("t")).select("i", "j", F.year("t").alias("y"), F.month("t").alias("m")).first()
    return Dims(last["i"] + 1, last["j"] + 1, (last["y"] - 1990) * 12 + last["m"])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by event types by hours with high values."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("value >= 110")
    kinds = F.array(*(F.lit(k) for k in ("click", "error", "purchase", "signup", "view")))
    kind = F.array_position(kinds, F.col("event_type")) - 1
    return rows.select((F.col("user_id") % 40).cast("long").alias("i"), kind.cast("long").alias("j"), F.hour("ts").cast("long").alias("k")).where("j >= 0").distinct()
