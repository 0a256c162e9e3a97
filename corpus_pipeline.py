"""A corpus from raw documents to training shards, as stages over the operators of recordloom.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as
Parquet in the shared folder and read again as the next one's documents, and removed once
that is written. All but the last return the columns of their input, whatever other
columns there are. In every stage very long texts are read whole and an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import decontamination, mixing, neardup, quality, sharding
from recordloom.llm.common import remove, scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, on hosts that pass. A null or empty text has no words and goes."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id (null last), of each class of near copies; of equal rows one."""
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's question and answer; a null text has none and stays."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in training order, each as often as its source's target has it; texts without words are never taken."""
    return mixing.training_order(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mixed corpus with its shard and slot.

    The documents' columns all stay; one called size, text_crc32, shard, slot or row_number
    gets "docs_" before its name. Rows that are equal have slots each.
    """
    return sharding.shard(docs, shards=8, carry=True)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("sharding", shard),
]

#: The near-duplicate stage rests on hashed samples; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
