"""Lookups in state tables, as joins.

State tables: (key, value); (key, effective_time, value); (key_start, key_end, value), with or without effective_time;
sessions (key, start, end). A lookup keeps every row of the left table and adds the value, or null.

As-of lookups deal each key's rows and states out by buckets of the order (see buckets.py). States, rows and, for each
key and bucket, the state that holds at the bucket's start are sorted together within (key, bucket), and a window
carries the last state forward: the rows are shuffled once, and a key with a third of all rows is spread over as many
tasks as there are buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.scalar import col
from eventloom.functions.states import StateValue

from .buckets import with_bucket


def state_lookup(
    df: DataFrame, states: DataFrame, key: str, into: str = "value", state_key: str = "key", state_value: str = "value", written: str | None = None
) -> DataFrame:
    """The value of an exact key. Of several values of a key the one written last counts, by the `written` column; the
    greatest one if there is no such column."""
    value = F.max(state_value) if written is None else F.max_by(state_value, F.struct(written, state_value))
    one = states.groupBy(F.col(state_key).alias("_key")).agg(value.alias(into))
    return df.join(one, df[key] == one["_key"], "left").drop("_key")


def chained_lookup(df: DataFrame, maps: list[DataFrame], key: str, into: str = "value") -> DataFrame:
    """map1/map2/…: the value of one map is the key of the next."""
    out, at = df, key
    for i, states in enumerate(maps):
        name = into if i == len(maps) - 1 else f"_hop{i}"
        out = state_lookup(out, states, at, name)
        at = name
    return out.drop(*[f"_hop{i}" for i in range(len(maps) - 1)])


def as_of(df: DataFrame, states: DataFrame, keys: list[str], order: str, state_order: str, values: list[str], buckets: int | None = None) -> DataFrame:
    """For each row of df the values of the state of the same keys with the greatest state_order at or below order.

    Of states equal in key and order the greatest values are taken. Rows with a null key or order find nothing. Columns
    of df whose names begin with `_as_of` are reserved. keys may be empty: all rows then share one history.

    The plan names df four times (rows, bounds of the buckets, and both again for what carries over): write a table
    between the lookups of a chain of more than two or three."""
    held = F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
    right = states.where(known & F.col(state_order).isNotNull()).select(*keys, F.col(state_order).alias("_as_of"), held.alias("_as_of_v"), F.lit(1).alias("_as_of_s"))
    left = df.withColumns({"_as_of": F.col(order).cast(right.schema["_as_of"].dataType), "_as_of_s": F.lit(2)})
    both = with_bucket(left.unionByName(right, allowMissingColumns=True), "_as_of", "_as_of_b", buckets)
    by = [*keys, "_as_of_b"]

    # what holds at the start of each bucket that has rows or states: the last state of the buckets before
    end = F.max(F.when(F.col("_as_of_s") == 1, F.struct("_as_of", "_as_of_v"))).alias("_as_of_e")
    ends = both.where(known & F.col("_as_of").isNotNull()).groupBy(*by).agg(end)
    before = Window.partitionBy(*keys).orderBy("_as_of_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, F.last("_as_of_e", ignorenulls=True).over(before)["_as_of_v"].alias("_as_of_v"), F.lit(0).alias("_as_of_s")).where("_as_of_v is not null")

    # carried states sort first, and states before rows of the same order
    upto = Window.partitionBy(*by).orderBy(F.col("_as_of").asc_nulls_first(), "_as_of_s", "_as_of_v").rowsBetween(Window.unboundedPreceding, 0)
    found = both.unionByName(carried, allowMissingColumns=True).withColumn("_as_of_f", F.last("_as_of_v", ignorenulls=True).over(upto)).where("_as_of_s = 2")
    usable = known & F.col("_as_of").isNotNull()
    return found.select(*df.columns, *[F.when(usable, F.col("_as_of_f")[f"v{i}"]).alias(v) for i, v in enumerate(values)])


def temporal_lookup(df: DataFrame, states: DataFrame, key: str, time: str, into: str = "value", state_key: str = "key", effective: str = "effective_time", state_value: str = "value") -> DataFrame:
    """The value in force at a time: the latest effective time at or before it."""
    right = states.select(F.col(state_key).alias("_lookup"), millis_micro(effective).alias("_eff"), F.col(state_value).alias(into))
    left = df.withColumns({"_lookup": F.col(key), "_at": millis_micro(time)})
    return as_of(left, right, ["_lookup"], "_at", "_eff", [into]).drop("_lookup", "_at")


def millis_micro(time: str) -> Column:
    """Microseconds since 1970 of a time column."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(time).cast("timestamp_ntz"))


def ranged_lookup(df: DataFrame, ranges: DataFrame, key: str, into: str = "value", start: str = "key_start", end: str = "key_end", state_value: str = "value", buckets: int | None = None) -> DataFrame:
    """The value of the range with the greatest start at or below the key, if the range reaches the key; an earlier
    range that encloses it is not tried. One as-of lookup over all rows, spread by buckets of the key."""
    right = ranges.select(F.col(start).cast("bigint").alias("_start"), F.struct(F.col(end).alias("end"), F.col(state_value).alias("value")).alias("_hit"))
    left = df.withColumn("_at", F.col(key).cast("bigint"))
    joined = as_of(left, right, [], "_at", "_start", ["_hit"], buckets)
    return joined.withColumn(into, F.when(F.col("_hit.end") >= F.col("_at"), F.col("_hit.value"))).drop("_at", "_hit")


def temporal_ranged_lookup(df: DataFrame, ranges: DataFrame, key: str, time: str, into: str = "value", start: str = "key_start", end: str = "key_end", effective: str = "effective_time", state_value: str = "value") -> DataFrame:
    """The value of the range with the greatest start at or below the key, among those that reach it and are in force:
    of equal starts the latest effective time at or before the time."""
    starts = ranges.select(F.col(start).cast("bigint").alias("_start"), F.col(start).cast("bigint").alias("_own"))
    left = df.withColumns({"_at": F.col(key).cast("bigint"), "_time": millis_micro(time)})
    nearest = as_of(left, starts.distinct(), [], "_at", "_start", ["_own"])
    hits = ranges.select(F.col(start).cast("bigint").alias("_own"), millis_micro(effective).alias("_eff"), F.struct(F.col(end).alias("end"), F.col(state_value).alias("value")).alias("_hit"))
    joined = as_of(nearest, hits, ["_own"], "_time", "_eff", ["_hit"])
    return joined.withColumn(into, F.when(F.col("_hit.end") >= F.col("_at"), F.col("_hit.value"))).drop("_own", "_at", "_time", "_hit")


def session_lookup(df: DataFrame, sessions: DataFrame, key: str, time: str, into: str = "in_session", session_key: str = "key", start: str = "start", end: str = "end") -> DataFrame:
    """Whether the key is in a session at a time, both ends included. Sessions of one key must not overlap
    (sessions.merge_sessions() sees to that), so the latest one that has started decides."""
    right = sessions.select(F.col(session_key).alias("_lookup"), millis_micro(start).alias("_start"), millis_micro(end).alias("_end"))
    left = df.withColumns({"_lookup": F.col(key), "_at": millis_micro(time)})
    joined = as_of(left, right, ["_lookup"], "_at", "_start", ["_end"])
    return joined.withColumn(into, F.coalesce(F.col("_at") <= F.col("_end"), F.lit(False))).drop("_lookup", "_at", "_end")


def state_value(df: DataFrame, states: DataFrame, asked: StateValue, into: str) -> DataFrame:
    """getState(): df with the value that it asks for. The columns of the table tell its kind; sessions give true or
    false. A column named `into` is replaced."""
    has = lambda *names: set(names) <= set(states.columns)
    rest = [c for c in df.columns if c != into]
    df = df.withColumns({"_asked": col(asked.key), "_when": F.localtimestamp() if asked.time is None else col(asked.time)})
    if has("key_start", "effective_time"):
        found = temporal_ranged_lookup(df, states, "_asked", "_when", "_value")
    elif has("key_start"):
        found = ranged_lookup(df, states, "_asked", "_value")
    elif has("start", "end"):
        found = session_lookup(df, states, "_asked", "_when", "_value")
    elif has("effective_time"):
        found = temporal_lookup(df, states, "_asked", "_when", "_value")
    else:
        found = state_lookup(df, states, "_asked", "_value")
    return found.select(*rest, F.col("_value").alias(into))


def bitmap_lookup(df: DataFrame, states: DataFrame, number: str, keys: list[str], into: str = "values") -> DataFrame:
    """The values of all set bits of a number, by bit, as an array; keys identify the rows of df."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.getbit(F.col(number).cast("bigint"), i) == 1)
    each = df.select(*keys, F.explode(bits).alias("_bit"))
    met = state_lookup(each, states, "_bit", "_v").where(F.col("_v").isNotNull())
    gathered = met.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_bit", "_v"))), lambda x: x["_v"]).alias(into))
    return df.join(gathered, keys, "left")


def reference_lookup(df: DataFrame, streams: DataFrame, entries: DataFrame, key: str, time: str, into: str = "value") -> DataFrame:
    """The value of a key in the reference stream that was effective at a time. streams: (feed-wide) stream_id and
    effective_time; entries: stream_id, key, value."""
    effective = streams.select(millis_micro("effective_time").alias("_eff"), F.col("stream_id").alias("_stream"))
    placed = as_of(df.withColumn("_time", millis_micro(time)), effective, [], "_time", "_eff", ["_stream"]).drop("_time")
    pairs = entries.select(F.col("stream_id").alias("_in"), F.col("key").alias("_key"), F.col("value").alias(into))
    met = (placed["_stream"] == pairs["_in"]) & (placed[key] == pairs["_key"])
    return placed.join(pairs, met, "left").drop("_stream", "_in", "_key")


def mapped_lookup(df: DataFrame, streams: DataFrame, entries: DataFrame, maps: str, key: str, time: str, into: str = "value") -> DataFrame:
    """lookup('map1/map2', key, time): the value of one map is the key of the next.

    streams: stream_id, effective_time and map; entries: stream_id, map and value with a key, or with key_start and
    key_end for ranges of whole numbers. In each map the stream that was effective at the time counts; an exact entry
    goes before a range, and of the ranges the one with the greatest start at or below the key."""
    out, at = df, key
    names = maps.split("/")
    for i, name in enumerate(names):
        value = into if i == len(names) - 1 else f"_hop{i}"
        own = streams.where(F.col("map") == name)
        effective = own.select(millis_micro("effective_time").alias("_eff"), F.col("stream_id").alias("_stream"))
        out = as_of(out.withColumn("_time", millis_micro(time)), effective, [], "_time", "_eff", ["_stream"]).drop("_time")
        here = entries.where(F.col("map") == name)
        exact = here.where("key is not null").groupBy(F.col("stream_id").alias("_in"), F.col("key").alias("_key")).agg(F.max("value").alias("_exact"))
        out = out.join(exact, (out["_stream"] == exact["_in"]) & (out[at].cast("string") == exact["_key"]), "left").drop("_in", "_key")
        ranges = here.where("key_start is not null").select(F.col("stream_id").alias("_stream"), F.col("key_start").alias("_start"), F.struct(F.col("key_end").alias("end"), "value").alias("_hit"))
        out = as_of(out.withColumn("_at", F.col(at).try_cast("bigint")), ranges, ["_stream"], "_at", "_start", ["_hit"])
        out = out.withColumn(value, F.coalesce("_exact", F.when(F.col("_hit.end") >= F.col("_at"), F.col("_hit.value")))).drop("_stream", "_exact", "_hit", "_at")
        at = value
    return out.drop(*[f"_hop{i}" for i in range(len(names) - 1)])


def annotate(df: DataFrame, annotations: DataFrame, keys: tuple[str, str] = ("stream_id", "event_id")) -> DataFrame:
    """Adds the annotations of each event, as columns of the annotation table."""
    return df.join(annotations, list(keys), "left")
