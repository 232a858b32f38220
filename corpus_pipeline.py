"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontam, minhash_join, mixing, sharding, toxicity
from lodestone.llm.common import shared_dir, table
from lodestone.llm.queries import BLOCK_BYTES, SHARD_BYTES


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that the classifier calls toxic, each judged by its own text: repeated rows all
    stay or all go, null and empty texts are judged as empty ones, an empty table gives none."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity 0.8 or more. Of equal ids, one text
    stays with all its repeated rows; null and blank texts stay; an empty table gives none."""
    return minhash_join.without_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the documents that hold a test item; null and empty texts stay, and so does everything where
    there are no items."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Orders the documents by their slot in the mixture; all are kept, also those without text, source or id.
    Rows of one slot are in the order of their ids."""
    mixed = mixing.mix_sources(docs, block_bytes=BLOCK_BYTES)
    return mixed.repartitionByRange("mix_slot", "doc_id").sortWithinPartitions("mix_slot", "doc_id").select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: dict | None = None) -> DataFrame:
    """Deals the documents to shards within the byte limit. The order of the mixing stage's files
    doesn't outlast a join, so each row's slot is computed again and returned (mix_source,
    mix_block, mix_slot); within a shard, rows are in the order of their slots. Null, repeated and equal
    rows are spread over shards that fit; a text over the limit is a shard by itself."""
    mixed = mixing.mix_sources(docs, weights, block_bytes=BLOCK_BYTES)
    return sharding.shard_rows(mixed, SHARD_BYTES).repartition("shard").sortWithinPartitions("shard", "mix_slot", "doc_id")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier is not expressible in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on `documents`: what the last returns for what the others kept. Each
    result is written to the shared folder and read again, so a lost executor costs one stage's work at
    most. Other columns of the table are kept, under their own names, up to the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
