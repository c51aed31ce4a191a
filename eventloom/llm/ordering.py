"""Running totals and weighted cuts over a distributed order, without sorting in one place."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 256
MOST_BUCKETS = 1 << 16


def shuffled(*columns: Column | str, seed: int = 0) -> Column:
    """A non-negative long that orders rows pseudo-randomly by the given columns."""
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def bucket_bits(rows: int) -> int:
    """Leading bits of a shuffled order that make buckets of about ROWS_PER_BUCKET rows, MOST_BUCKETS at most."""
    return min(max(0, math.ceil(math.log2(max(1, rows) / ROWS_PER_BUCKET))), int(math.log2(MOST_BUCKETS)))


def running_total(df: DataFrame, group: list[str], order: str, ties: list[str], weight: str, rows: int, into: str) -> DataFrame:
    """Adds `into`: the weight of the rows of the same group that come before, by order and then ties.

    order: a shuffled() column. Its leading bits make buckets; the bucket sums (at most MOST_BUCKETS a group, and
    never more than there are rows) give each bucket's start, so one hot group is spread over many tasks. group
    columns must not be null. Rows that are equal in order and ties get distinct totals in no fixed order.
    """
    bits = bucket_bits(rows)
    df = df.withColumn("_bucket", F.shiftrightunsigned(F.col(order), 63 - bits) if bits else F.lit(0).cast("long"))
    by_bucket = df.groupBy(*group, "_bucket").agg(F.sum(weight).alias("_sum"))
    starts = by_bucket.withColumn("_start", F.sum("_sum").over(Window.partitionBy(*group).orderBy("_bucket")) - F.col("_sum")).drop("_sum")
    within = Window.partitionBy(*group, "_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_within", F.sum(weight).over(within) - F.col(weight))
        .join(starts, [*group, "_bucket"])
        .withColumn(into, F.col("_start") + F.col("_within"))
        .drop("_bucket", "_start", "_within")
    )
