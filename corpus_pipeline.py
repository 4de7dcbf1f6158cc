"""A corpus pipeline: classify, dedup, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns the columns of
documents; the last adds the shards. A stage's result is written as Parquet and read again as the next one's docs.
Empty stages give empty results; nulls are handled as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siloforge.llm import decontaminate, mixing, quality, sharding, simhash
from siloforge.session import cut, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash.dedup(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark passages."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with all its columns, and size, text_crc32, law, shard and slot: the corpus to train on."""
    return sharding.shard(docs).withColumn("law", F.lit("rows"))


STAGES = [("quality classifier", classify), ("simhash near-dedup", deduplicate), ("benchmark decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]

#: SQL can express neither the classifier nor the signatures; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = cut(docs, f"stage{n}")
    return docs
