"""Keeping state tables small: merging sessions and parts, condensing, retention."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buckets import with_bucket

def _merge_intervals(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("_reach"), 0).otherwise(1)).over(order)
    marked = intervals.withColumn("_reach", reach).withColumn("_island", island)
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def merge_sessions(sessions: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", buckets: int | None = None) -> DataFrame:
    """Overlapping or touching intervals of a key become one: (keys, start, end). Intervals without an end or a start
    are left out; reversed ones are turned round. Intervals are merged within buckets of the start first, so that a hot
    key leaves few of them for the merge over its whole time."""
    lo, hi = F.least(start, end), F.greatest(start, end)
    plain = sessions.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, lo.alias("start"), hi.alias("end"))
    near = _merge_intervals(with_bucket(plain, "start", "_bucket", buckets=buckets), [*keys, "_bucket"])
    return _merge_intervals(near.drop("_bucket"), keys)


def sessions_of(events: DataFrame, keys: Sequence[str], time: str, gap: str) -> DataFrame:
    """(keys, start, end, n): events of a key that follow each other within the gap, by Spark's session window, which
    merges in each task before it shuffles."""
    grouped = events.where(F.col(time).isNotNull()).groupBy(*keys, F.session_window(F.col(time), gap).alias("w"))
    return grouped.agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n")).drop("w")


def latest(parts: Sequence[DataFrame], keys: Sequence[str], order: str, overwrite: bool = True) -> DataFrame:
    """State parts as one table: for each key the row of the greatest order (or the least, if values are not to be
    overwritten)."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rest = [c for c in both.columns if c not in keys]
    pick = F.max_by if overwrite else F.min_by
    return both.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def condense(states: DataFrame, keys: Sequence[str], time: str, value: str, before: Column | None = None, buckets: int | None = None) -> DataFrame:
    """Drops states that repeat the value before them; with `before`, only older ones. Rows are compared within buckets
    of the time; the first of a bucket is compared with the last value of the buckets before, one row a bucket."""
    placed = with_bucket(states, time, "_bucket", buckets=buckets)
    ends = placed.groupBy(*keys, "_bucket").agg(F.max(F.struct(F.col(time).alias("t"), F.col(value).alias("v"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket")
    carry = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), F.lag("_end").over(earlier).alias("_carry"))
    seen = F.lag(F.struct(F.col(time).alias("t"), F.col(value).alias("v"))).over(Window.partitionBy(*keys, "_bucket").orderBy(time))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_bucket") == F.col("_b")]
    last = placed.withColumn("_seen", seen).join(carry, same).withColumn("_last", F.coalesce("_seen", "_carry"))
    repeated = F.col("_last").isNotNull() & F.col(value).eqNullSafe(F.col("_last.v"))
    if before is not None:
        repeated &= F.col(time) < before
    return last.where(~repeated).select(*states.columns)


def delete_before(states: DataFrame, time: str, before: Column) -> DataFrame:
    return states.where(F.col(time) >= before)


def retain(streams: DataFrame, rules: Sequence[tuple[Column, str | None]], time: str, now: Column) -> DataFrame:
    """Data retention: the first rule (condition, age such as `30 days`, or None for ever) that holds decides; rows
    past its age go, rows without a rule stay."""
    keep = F.lit(True)
    for condition, age in reversed(rules):
        young = F.lit(True) if age is None else F.col(time) >= now - F.expr(f"interval {age}")
        keep = F.when(F.coalesce(condition, F.lit(False)), F.coalesce(young, F.lit(True))).otherwise(keep)
    return streams.where(keep)


def suppress_duplicates(rows: DataFrame, columns: Sequence[str] | None = None, seen: DataFrame | None = None) -> DataFrame:
    """One row for each combination of the columns (all, if none are given), less those seen before."""
    by = list(columns or rows.columns)
    once = rows.dropDuplicates(by)
    if seen is None:
        return once
    return once.join(seen.select(*by).distinct(), [once[c].eqNullSafe(seen[c]) for c in by], "left_anti")
