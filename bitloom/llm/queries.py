"""The queries op1 to op10 over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import bpe, embeddings, language, lines, lm, media, minhash, packing, pii, quality
from bitloom.llm.common import documents, id_bucket
from bitloom.llm.oracle import SQL


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = language.train(docs.where(id_bucket("doc_id", 3) != 1))
    found = language.label(docs, model)
    return found.select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = lm.train(docs.where(id_bucket("doc_id", 7) != 2))
    held_out = (id_bucket("doc_id", 7) == 2).alias("held_out")
    return lm.score(docs, model).select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality.train(docs, labels.where(id_bucket("doc_id", 4) != 2))
    found = quality.scored(docs, rules)
    return found.select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.replace(documents(spark, sf_dir, "doc_id", "text"), spans_col="entities")
    return found.select("doc_id", "text", F.size("entities").alias("n_entities"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path("byte_bpe_50k.json")))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.media_columns(documents(spark, sf_dir, "doc_id", "text")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return lines.dedup(docs, removed_col="n_removed").select("doc_id", "text", "n_removed")


__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_language": op1_language, "op2_embeddings": op2_embeddings, "op3_lm": op3_lm, "op4_quality": op4_quality, "op5_minhash": op5_minhash, "op6_pii": op6_pii, "op7_bpe": op7_bpe, "op8_media": op8_media, "op9_packing": op9_packing, "op10_lines": op10_lines}
