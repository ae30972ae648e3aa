"""Five stages from documents to packed sequences. Each works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import common, lines, minhash, packing, pii, quality
from bitloom.llm.queries import tokenizer_path


def _sized(docs: DataFrame) -> DataFrame:
    """docs with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; null texts are scored as empty ones, repeated rows one by one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(common.id_bucket("doc_id", 4) != 2)
    rules = quality.train(docs, labels)
    return quality.kept(docs, rules)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier one; a document that loses all its lines stays, with an empty text.

    Null texts and rows with a null id stay as they are; rows of one id share their lines' fate.
    """
    return _sized(lines.dedup(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the least id. Rows of one id are one document; those without
    an id or without words stay. The sets have shingles of five words, as near-duplicate stages have that no contract binds."""
    found = minhash.near_duplicates(docs, words=5)
    return common.without(docs, found.where("not kept and doc_id is not null").select("doc_id"), "doc_id")


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; null texts stay null, and equal texts become equal texts."""
    return _sized(pii.replace(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences; a null text is an empty one, and repeated rows are packed one by one."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("lines", drop_lines),
    ("minhash", drop_copies),
    ("pii", hide_private),
    ("packing", pack),
]

#: SQL cannot express the learned rules, the surrogates and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        docs = common.stored(found, docs) if k < len(STAGES) - 1 else found
    return docs
