"""What the operators of this package share: inputs, shared scratch tables, Arrow batches, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of one Arrow batch sent to a Python worker, so that long texts do not pile up in one batch.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000

#: Cells of the tables that tell which rows may be concerned: such a table has at most as many rows, of 8 bytes.
MARKS = 1 << 19

#: With this setting Spark deletes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: dict[str, SparkSession] = {}


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share.

    Where that is not set, the checkpoint folder of the Spark context is taken; in local mode, where all run on one machine,
    a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.split("[")[0] == "local":
        base = tempfile.mkdtemp(prefix="bitloom-")
        spark.sparkContext.setCheckpointDir(base)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{base.rstrip('/')}/bitloom-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(remove_scratch)
    _made[path] = spark
    return path


def remove_scratch() -> None:
    """Delete the scratch folders of sessions that still run."""
    for path in list(_made):
        _delete(path)


def _delete(path: str) -> None:
    spark = _made.pop(path, None)
    if spark and spark.sparkContext._jsc is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, *over: DataFrame) -> DataFrame:
    """df written to the shared scratch folder and read again: its lineage is cut and it survives lost executors.

    Shuffle files of the write are deleted at its end, and so are the stored tables over, of which it was the last reader.
    """
    spark = df.sparkSession
    path, before = scratch_folder(spark), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    drop(*over)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that no one reads any more."""
    for t in tables:
        _delete(getattr(t, "_scratch", ""))


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, Iterable]]], schema: str) -> DataFrame:
    """Each Arrow batch through the function that make() builds once a task; it returns columns by name."""
    small_batches(df.sparkSession)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                arrays = [x if isinstance(x := out[n], pa.Array) else pa.array(x, arrow.field(n).type) for n in arrow.names]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as bucket 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(0)).cast("int")


def cells(keys: DataFrame, cells: int = MARKS) -> DataFrame:
    """The cells that the rows of keys fall into: a table of at most so many rows, to be broadcast."""
    return F.broadcast(keys.select(_cell(keys.columns, cells).alias("__cell")).distinct())


def _cell(columns: list[str], cells: int) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(*columns), F.lit(cells)), F.lit(0))


def maybe(rows: DataFrame, found: DataFrame, columns: list[str], how: str = "left_semi", cells: int = MARKS) -> DataFrame:
    """The rows that may be among the keys whose cells are found (those that are always stay); with left_anti, the others."""
    return rows.withColumn("__at", _cell(columns, cells)).join(found, F.col("__at") == F.col("__cell"), how).drop("__at")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in gone. Only rows that may be concerned are shuffled."""
    gone = stored(gone.select(F.col(key).alias("key")).distinct())
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col(f"`{key}`").alias("key"))
    found = cells(gone)
    some = maybe(packed, found, ["key"]).join(gone.hint("shuffle_hash"), "key", "left_anti").select("row")
    return maybe(packed, found, ["key"], "left_anti").select("row").unionAll(some).select("row.*")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that can be reached over the edges, for nodes that have one.

    Alternating large-star and small-star rounds; each is a distributed aggregation of a linear number of edges and each
    is written to the shared folder. A node of very many edges is never collected: only minima are taken over neighbours.
    """
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        before = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if not before["n"]:
            break
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(least.select("u", F.col("m").alias("v")).unionAll(small).distinct(), e)
        after = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if after == before:
            break
    lone = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(lone).groupBy("node").agg(F.min("component").alias("component"))
