"""Parts of an order that hold about as many rows each, so that one key's rows spread over many tasks.

The bounds are approximate quantiles, found by a scalar subquery of the same plan: nothing runs while a plan is built,
and where rows lie decides, not how far apart the ends are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wanted(df: DataFrame) -> int:
    """As many buckets as the session has shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def number(kind: T.DataType, x: Column) -> Column:
    """A time, a number or the first field of a struct as a double."""
    if isinstance(kind, T.StructType):
        x, kind = x[kind.fields[0].name], kind.fields[0].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        x = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), x.cast("timestamp_ntz"))
    return x.cast("double")


def with_bucket(df: DataFrame, order: str, into: str, buckets: int | None = None) -> DataFrame:
    """df with the bucket of each row, from 0. A null order falls to bucket 0."""
    n = buckets or wanted(df)
    everything = df.select(number(df.schema[order].dataType, F.col(order)).alias("x"))
    cuts = everything.agg(F.percentile_approx("x", [k / n for k in range(1, n)] or [1.0], 20 * n)).scalar()
    out = df.withColumns({f"{into}_cuts": cuts, f"{into}_x": number(df.schema[order].dataType, F.col(order)), into: F.lit(0)})
    step = 1 << max(0, (n - 1).bit_length() - 1)
    while step and n > 1:  # a binary search for how many cuts lie at or below
        above = F.try_element_at(f"{into}_cuts", F.col(into) + step) <= F.col(f"{into}_x")
        out = out.withColumn(into, F.col(into) + F.when(above, step).otherwise(0))
        step >>= 1
    return out.drop(f"{into}_cuts", f"{into}_x")
