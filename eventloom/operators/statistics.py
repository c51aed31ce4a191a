"""Time-bucketed statistics with tag rollups.

A statistic event has a time, a name, tags and a count or a value. Times are floored to a precision, tag combinations
are rolled up to `*`, and rows of equal time, name and tags are merged: counts add up, values add up with their counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.dates import from_millis, millis

#: Milliseconds of the precisions.
PRECISIONS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
ROLLED = "*"


def floor_to(time: str | Column, precision: str) -> Column:
    size = PRECISIONS[precision]
    return from_millis(F.floor(millis(time) / size).cast("bigint") * size)


def masks(tags: Sequence[str], kind: str = "all", custom: Iterable[Sequence[str]] = ()) -> list[list[str]]:
    """The tag sets that stay, by rollup type: none (all tags stay), all (every subset) or custom (the rolled tags of
    each mask)."""
    if kind == "none":
        return [list(tags)]
    if kind == "all":
        return [list(c) for n in range(len(tags), -1, -1) for c in combinations(tags, n)]
    return [[t for t in tags if t not in rolled] for rolled in custom]


def rollup(
    events: DataFrame, time: str, tags: Sequence[str], precision: str = "hour", count: Column | None = None, value: Column | None = None, kind: str = "all", custom: Iterable[Sequence[str]] = ()
) -> DataFrame:
    """time_bucket, the tags (`*` where rolled up; missing tags are empty texts), n (the count) and, for values, total.

    One aggregation over the grouping sets: rows are first merged by all tags, so the sets multiply merged rows."""
    measures = [F.sum(count if count is not None else F.lit(1)).alias("n")]
    if value is not None:
        measures.append(F.sum(value).alias("total"))
    tagged = events.withColumns({"time_bucket": floor_to(time, precision), **{t: F.coalesce(F.col(t).cast("string"), F.lit("")) for t in tags}})
    merged = tagged.groupBy("time_bucket", *tags).agg(*measures)
    sets = [["time_bucket", *keep] for keep in masks(tags, kind, custom)]
    again = [F.sum(m).alias(m) for m in ("n", "total")[: len(measures)]]
    rolled = merged.groupingSets(sets, "time_bucket", *tags).agg(*again, *[F.grouping(t).alias(f"_{t}") for t in tags])
    return rolled.select("time_bucket", *[F.when(F.col(f"_{t}") == 1, ROLLED).otherwise(F.col(t)).alias(t) for t in tags], "n", *(["total"] if value is not None else []))


def merge_statistics(*parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statistics of several sources as one: n and total (if there) add up by key."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "total") if c in both.columns])


def coarsen(stored: DataFrame, keys: Sequence[str], before: Column, precision: str) -> DataFrame:
    """Rows older than `before` merge into buckets of a coarser precision; newer rows stay."""
    bucket = F.when(F.col("time_bucket") < before, floor_to("time_bucket", precision)).otherwise(F.col("time_bucket"))
    moved = stored.withColumn("time_bucket", bucket)
    return moved.groupBy("time_bucket", *keys).agg(*[F.sum(c).alias(c) for c in ("n", "total") if c in stored.columns])


def mean_value(total: str = "total", n: str = "n") -> Column:
    return F.try_divide(F.col(total).cast("double"), F.col(n).cast("double"))


def validate(events: DataFrame, time: str, name: str, count: str | None = None, value: str | None = None) -> DataFrame:
    """Adds `problem`: why an event is no valid statistic, or null."""
    given = [F.col(c).isNotNull() for c in (count, value) if c]
    problem = F.when(F.col(time).isNull(), "no time").when(F.coalesce(F.col(name), F.lit("")) == "", "no name")
    if len(given) == 2:
        problem = problem.when(given[0] & given[1], "count and value").when(~given[0] & ~given[1], "no count or value")
    elif given:
        problem = problem.when(~given[0], "no count or value")
    return events.withColumn("problem", problem)
