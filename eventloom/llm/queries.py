"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, line_crf, line_templates, mixing, near_dedup, ngram_quality, sharding, suffix_dedup, training_order
from .scratch import shared_uri


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards of all documents under the shared folder; a row for each record, read from the files."""
    ranks = training_order.read_vocabulary(spark, training_order.VOCABULARY)
    plan = training_order.plan(_table(spark, sf_dir, "documents"), ranks, key=20240229)
    uri = shared_uri(spark, "shards")
    return training_order.records_of(plan, training_order.write_shards(plan, uri), uri)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of 100 * shared >= 80 * either on sets of four-word shingles."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items each document holds, as they are or with other numbers, names and units."""
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3, repeating; the budget is all words, no source above 3 times its own."""
    plan = mixing.schedule(_table(spark, sf_dir, "documents"), weights=(1, 2, 3), most_repeats=3, cut="word")
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda so_far, x: so_far + x["taken_words"])
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("draws").alias("n_draws"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that a repeated string of 100 bytes covers go, the earliest one stays."""
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the line labels; fitted on labelled documents."""
    docs = _table(spark, sf_dir, "documents")
    return line_crf.judge(docs, line_crf.fit(docs, _table(spark, sf_dir, "labels")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents whose crc32(doc_id) mod 4 is not 2; the others are held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = language_id.fit(docs.where(remainder != 2))
    return language_id.predict(docs.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "text"), model).drop("text", "known")


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts less the lines that recur in two documents, or their template in three; the first line of each stays."""
    return line_templates.drop_recurring_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of trusted text, against its language's quantile."""
    return ngram_quality.keep(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards of near equal bytes."""
    placed = sharding.assign(_table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_training_order, op2_minhash_near_dedup, op3_template_decontamination, op4_source_mix, op5_suffix_dedup, op6_line_crf, op7_language_id, op8_line_templates, op9_kneser_ney_quality, op10_kd_shards)}
ORACLE_SQL: dict[str, str] = {}
