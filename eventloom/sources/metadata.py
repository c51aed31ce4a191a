"""The metadata tables that queries may read like any other, built from events, indexes and detections.

Their columns are those of readers.SCHEMAS."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import SCHEMAS


def conform(df: DataFrame, name: str) -> DataFrame:
    """df in the columns and types of a metadata table; columns that it lacks are null."""
    fields = T.StructType.fromDDL(SCHEMAS[name]).fields
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def stream_meta(records: DataFrame, stream: str, feed: str, kind: str, time: str, severity: str | None = None, raw: str | None = None) -> DataFrame:
    """One row for each stream of records: its feed, type, times, counts of records by severity and size in bytes."""
    count = lambda name: F.count(F.when(F.upper(F.col(severity)) == name, 1)) if severity else F.lit(0)
    size = F.sum(F.octet_length(raw)) if raw else F.lit(None)
    found = records.where(F.col(stream).isNotNull()).groupBy(F.col(stream).alias("Id")).agg(
        F.min(feed).alias("Feed"), F.min(kind).alias("Type"), F.min(time).alias("CreateTime"), F.min(time).alias("EffectiveTime"), F.max(time).alias("StatusTime"), F.count("*").alias("ReadCount"),
        count("INFO").alias("InfoCount"), count("WARNING").alias("WarningCount"), count("ERROR").alias("ErrorCount"), count("FATAL").alias("FatalErrorCount"), size.alias("RawSize"),
    )
    took = F.timestamp_diff("MILLISECOND", F.col("CreateTime"), F.col("StatusTime"))
    return conform(found.withColumns({"Status": F.lit("Unlocked"), "Duration": took}), "stream_meta")


def processor_tasks(streams: DataFrame, outputs: DataFrame, pipeline: str, node: str) -> DataFrame:
    """One task for each stream and the pipeline: Complete if outputs (ParentId, StatusTime) hold one of it, else
    Created. Task ids follow from stream and pipeline."""
    done = outputs.groupBy(F.col("ParentId").alias("_parent")).agg(F.min("CreateTime").alias("_start"), F.max("StatusTime").alias("_end"))
    tasks = streams.join(done, streams["Id"] == done["_parent"], "left").select(
        F.xxhash64("Id", F.lit(pipeline)).alias("TaskId"), F.col("Id").alias("MetaId"), "Feed", F.lit(pipeline).alias("Pipeline"), F.lit(node).alias("Node"),
        F.when(F.col("_parent").isNotNull(), "Complete").otherwise("Created").alias("Status"), "CreateTime", F.col("_start").alias("StartTime"), F.col("_end").alias("EndTime"),
        F.coalesce("_end", "CreateTime").alias("StatusTime"),
    )
    return conform(tasks, "processor_tasks")


def index_shards(indexed: DataFrame, index: str, time: str, partition: str = "partition", node: str = "local") -> DataFrame:
    """One row for each time partition of an index: its documents and its last one's time."""
    found = indexed.groupBy(F.col(partition).cast("string").alias("Partition")).agg(F.count("*").alias("DocCount"), F.max(time).alias("LastCommit"))
    return conform(found.withColumns({"ShardId": F.xxhash64(F.lit(index), F.col("Partition")), "Index": F.lit(index), "Node": F.lit(node), "Status": F.lit("OPEN")}), "index_shards")


def annotations(df: DataFrame, stream_id: str, event_id: str, title: Column, created: str, status: str = "New", subject: Column | None = None, assigned_to: Column | None = None, comment: Column | None = None) -> DataFrame:
    """What the annotation writer makes of events: one annotation each."""
    none = F.lit(None).cast("string")
    return conform(
        df.select(
            F.col(stream_id).alias("stream_id"), F.col(event_id).alias("event_id"), title.alias("Title"), (none if subject is None else subject).alias("Subject"), F.lit(status).alias("Status"),
            (none if assigned_to is None else assigned_to).alias("AssignedTo"), (none if comment is None else comment).alias("Comment"), F.col(created).alias("CreatedOn"),
        ),
        "annotations",
    )


def reference_entries(df: DataFrame, stream_id: str, map_name: str | Column, value: Column, effective: str, key: Column | None = None, key_start: Column | None = None, key_end: Column | None = None) -> DataFrame:
    """Loads reference data: entries (stream_id, map, key, key_start, key_end, value, effective_time) with a key, or with
    a range of whole numbers. Entries without a value, or a key, are left out, and so are reversed ranges."""
    none = F.lit(None)
    rows = df.select(
        F.col(stream_id).alias("stream_id"), (F.lit(map_name) if isinstance(map_name, str) else map_name).alias("map"), (none if key is None else key).cast("string").alias("key"),
        (none if key_start is None else key_start).cast("bigint").alias("key_start"), (none if key_end is None else key_end).cast("bigint").alias("key_end"), value.cast("string").alias("value"),
        F.col(effective).alias("effective_time"),
    )
    return rows.where("value is not null and (key is not null or key_start <= key_end)")


def state_rows(df: DataFrame, kind: str, value: Column | None = None, **columns: Column) -> DataFrame:
    """Loads a state table (state, temporal_state, ranged_state, temporal_ranged_state or session): its key columns, with
    the value as text beside the name of its type. Rows with a null in a key column are left out."""
    rows = df.select(*[c.alias(n) for n, c in columns.items()], *([] if value is None else [F.initcap(F.typeof(value)).alias("ValueType"), value.cast("string").alias("value")]))
    for name in columns:
        rows = rows.where(F.col(name).isNotNull())
    return conform(rows, kind)


def analytic_store(detections: DataFrame) -> DataFrame:
    """Detections (rule, time, values) as rows of UUID, Name, Time and Value, one for each value. The UUID tells one
    detection from another and is the same when a rule runs again."""
    uuid = F.md5(F.to_json(F.struct("rule", "time", "values")))
    each = detections.select(uuid.alias("UUID"), F.col("time").alias("Time"), F.explode("values").alias("x"))
    return conform(each.select("UUID", F.col("x.name").alias("Name"), "Time", F.col("x.value").alias("Value")), "detections")


def statistic_messages(df: DataFrame, time: str, name: str, tags: Sequence[str], count: Column | None = None, value: Column | None = None) -> DataFrame:
    """(key, value) messages of statistic events for an external store: the statistic's name, and the event as JSON."""
    pairs = F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).cast("string").alias("value")) for t in tags])
    measure = F.struct((count if count is not None else F.lit(1)).cast("bigint").alias("count")) if value is None else F.struct(value.cast("double").alias("value"))
    body = F.struct(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"), F.lit(name).alias("name"), pairs.alias("tags"), *[measure[f].alias(f) for f in (["count"] if value is None else ["value"])])
    return df.select(F.lit(name).alias("key"), F.to_json(body).alias("value"))
