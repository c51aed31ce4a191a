"""The corpus pipeline: documents in, sharded training mix out.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns those that it keeps with the columns of
documents; the last adds each row's shard and slot. Stages are written as Parquet and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import decontamination, language_id, mixing, near_dedup, sharding
from eventloom.llm.scratch import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_KNOWN = 0.3
SHARDS = 40
WEIGHTS = (1, 2, 3)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language: null, without a letter, or with less than LEAST_KNOWN of their n-grams in any."""
    model = language_id.fit(docs)
    return language_id.predict(docs, model).where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("known") >= LEAST_KNOWN)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near duplicates: five-word shingles, 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs, shingle=5, percent=80).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, re-parameterised or not."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws whole documents from the sources to weights 1, 2, 3, repeating; a document drawn again is a further row."""
    return mixing.mix(docs, weights=WEIGHTS, cut="document").select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot: SHARDS leaves of a k-d tree of near equal bytes."""
    return sharding.shard(docs, SHARDS).select(*COLUMNS, "shard", "slot")


STAGES = [
    ("language ID", identify_language),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("source mixing", mix_sources),
    ("sharding", shard),
]

#: Hash sketches, trained models and tree cuts have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
