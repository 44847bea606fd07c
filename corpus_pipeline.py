"""The corpus pipeline: five stages over ``documents``, each over all its predecessor kept.

toxicity         toxic documents go
quality_rules    short or repetitive documents go
line_dedup       lines that repeat an earlier one are taken out
simhash_dedup    one document of each near-duplicate component stays
packing          token windows

All stages but the last return the columns of ``documents``; each is written as
Parquet in the shared folder and read again for the next. Nulls, repeated rows
and ties behave as the operators say. Rows that share a doc_id are told
apart by their texts in simhash_dedup.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sitegrain.llm import linedup, packing, repetition, simhash, toxicity
from sitegrain.llm.common import ship
from sitegrain.session import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, machine).filter("predicted = 0").select(docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return repetition.rated(docs, keep_text=True).filter("kept").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return linedup.without_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, value=packing.IDS_CRC32)


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_poor), ("line_dedup", drop_lines), ("simhash_dedup", drop_near_copies), ("packing", pack)]

#: The stages are a trained model and an iteration: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/corpus-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
