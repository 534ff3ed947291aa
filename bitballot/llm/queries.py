"""The registered queries of the operators: thin digests of their results over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitballot.llm import decontamination, embedding_dedup, language_id, licenses, mixing, ngram_join, pii, quality, sharding, token_counts
from bitballot.llm._common import Scratch, table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"), Scratch(spark)).drop("recall")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs.where(~held).select("doc_id", "text", "lang"))
    return language_id.label(docs, model, held=held)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark)).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"), 3, 1)
    return quality.score(docs, quality_model(spark, sf_dir), held=held)


def quality_model(spark: SparkSession, sf_dir: str) -> dict:
    """Trained on labelled rows of the documents table that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.fit(docs.where(~language_id.held_out(F.col("doc_id"), 3, 1)).join(labels, "doc_id"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), Scratch(spark), k=4, percent=85)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(table(spark, sf_dir, "documents"), 24, Scratch(spark))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_language_id, op3_token_counts, op4_mixing, op5_quality, op6_ngram_join, op7_sharding, op8_pii, op9_licenses, op10_decontamination)}
SQL = {"op1_embedding_dedup": embedding_dedup.SQL, "op4_mixing": mixing.SQL, "op6_ngram_join": ngram_join.SQL, "op10_decontamination": decontamination.SQL}
