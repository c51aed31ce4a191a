"""Tables and texts as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.operators.conditions import time_range, tokens

#: Schemas of the metadata tables that queries may read like any other.
SCHEMAS = {
    "stream_meta": "Feed string, Type string, Status string, Id bigint, CreateTime timestamp_ntz, EffectiveTime timestamp_ntz, StatusTime timestamp_ntz, ReadCount bigint, WriteCount bigint, InfoCount bigint, "
    "WarningCount bigint, ErrorCount bigint, FatalErrorCount bigint, Duration bigint, FileSize bigint, RawSize bigint, ParentId bigint",
    "processor_tasks": "TaskId bigint, MetaId bigint, Feed string, Pipeline string, Node string, Status string, CreateTime timestamp_ntz, StartTime timestamp_ntz, EndTime timestamp_ntz, StatusTime timestamp_ntz",
    "index_shards": "ShardId bigint, Node string, Index string, Partition string, Status string, DocCount bigint, FileSize bigint, LastCommit timestamp_ntz",
    "annotations": "stream_id bigint, event_id bigint, Title string, Subject string, Status string, AssignedTo string, Comment string, CreatedOn timestamp_ntz",
    "reference_entries": "stream_id bigint, Map string, key string, value string, EffectiveTime timestamp_ntz",
    "detections": "UUID string, Name string, Time timestamp_ntz, Value string",
    "state": "key string, ValueType string, value string",
    "temporal_state": "key string, effective_time timestamp_ntz, ValueType string, value string",
    "ranged_state": "key_start bigint, key_end bigint, ValueType string, value string",
    "temporal_ranged_state": "key_start bigint, key_end bigint, effective_time timestamp_ntz, ValueType string, value string",
    "session": "key string, start timestamp_ntz, end timestamp_ntz",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A metadata table without rows."""
    return spark.createDataFrame([], SCHEMAS[name])


def dual(spark: SparkSession) -> DataFrame:
    """One row of one text column."""
    return spark.range(1).select(F.lit("X").alias("Dummy"))


def view(df: DataFrame, name: str, condition: Column | None = None, extraction: dict[str, Column] | None = None) -> DataFrame:
    """A named view: a table, a filter and the fields that are extracted."""
    seen = df if condition is None else df.where(condition)
    seen = seen.withColumns(extraction) if extraction else seen
    seen.createOrReplaceTempView(name)
    return seen


def partition_filter(df: DataFrame, time: str, start: object = None, end: object = None, partition: str = "partition", unit: str = "day") -> DataFrame:
    """A time range, with the filter on the partition column that follows from it, so that Spark prunes partitions."""
    kept = df.where(time_range(time, start, end))
    first = lambda t: F.date_trunc(unit, F.lit(t).cast("timestamp_ntz")).cast("date")
    if start is not None:
        kept = kept.where(F.col(partition) >= first(start))
    return kept if end is None else kept.where(F.col(partition) <= first(end))


def with_partition(df: DataFrame, time: str, partition: str = "partition", unit: str = "day") -> DataFrame:
    """Adds the partition column of index shards: the start of the year, month, week or day."""
    return df.withColumn(partition, F.date_trunc(unit, F.col(time).cast("timestamp_ntz")).cast("date"))


def with_terms(df: DataFrame, text_fields: Sequence[str], analyser: str = "standard") -> DataFrame:
    """Adds the terms of text fields, as columns named <field>_terms."""
    return df.withColumns({f"{c}_terms": tokens(c, analyser) for c in text_fields})


def index_table(df: DataFrame, path: str, time: str, text_fields: Sequence[str] = (), unit: str = "day", analyser: str = "standard") -> None:
    """Writes events as an index: partitioned by time, with the terms of text fields beside them."""
    indexed = with_terms(with_partition(df, time, unit=unit), text_fields, analyser) if text_fields else with_partition(df, time, unit=unit)
    indexed.repartition("partition", F.pmod(F.hash(time), F.lit(16))).write.partitionBy("partition").mode("append").parquet(path)


def event_refs(df: DataFrame, stream_id: str = "stream_id", event_id: str = "event_id") -> DataFrame:
    """The distinct events of a result."""
    return df.select(stream_id, event_id).distinct()


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, a line a row."""
    return spark.read.text(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and value, a file a row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def csv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True, delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=header, sep=delimiter, encoding=encoding)


def json(spark: SparkSession, path: str, schema: str | T.StructType, whole: bool = False) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=whole)


def xml(spark: SparkSession, path: str, schema: str | T.StructType, row_tag: str) -> DataFrame:
    return spark.read.schema(schema).format("xml").option("rowTag", row_tag).load(path)


def connector(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    """A table of an external store (such as org.elasticsearch.spark.sql or solr), if its connector is on the class path."""
    return spark.read.format(kind).options(**options).load()
