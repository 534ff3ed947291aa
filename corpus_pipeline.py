"""Five stages from raw documents to shards.  Each reads what the stage before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitballot.llm import decontamination, mixing, ngram_join, quality, sharding
from bitballot.llm._common import Scratch, table
from bitballot.llm.queries import quality_model

SHARDS = 24


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (labels: the tables in sf_dir)."""
    return quality.accepted(docs, quality_model(spark, sf_dir))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8."""
    return ngram_join.representatives(docs, Scratch(spark), k=5, percent=80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), Scratch(spark))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs, Scratch(spark))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every copy."""
    return sharding.shard(docs, SHARDS, Scratch(spark))


STAGES = [("quality classifier", good), ("n-gram Jaccard join", unique), ("benchmark decontamination", uncontaminated), ("mixing", mixed), ("sharding", sharded)]

#: Learned scores and order hashes have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = table(spark, sf_dir, "documents"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = kept.save(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            kept.drop(f"stage-{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
