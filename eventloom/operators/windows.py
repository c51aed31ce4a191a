"""Hopping windows, aligned to 1970. A row counts in the window of its own advance step and, as a copy, in the windows
after it that still reach back to it; `period` tells how many steps back the row lies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.dates import from_millis, millis

_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def duration_ms(duration: str) -> int:
    """`10m` in milliseconds."""
    found = re.fullmatch(r"\s*(\d+)\s*(ms|s|m|h|d|w)\s*", duration)
    if not found:
        raise ValueError(f"not a duration: {duration}")
    return int(found[1]) * _MS[found[2]]


def periods(size: str, advance: str) -> int:
    return max(1, -(-duration_ms(size) // duration_ms(advance)))


def hopping(df: DataFrame, time: str = "ts", size: str = "10m", advance: str = "1m") -> DataFrame:
    """Adds window_start (the start of the window's newest step) and period to a copy of each row for each window."""
    step = duration_ms(advance)
    own = F.floor(millis(time) / step).cast("bigint") * step
    copies = df.withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(periods(size, advance) - 1))))
    return copies.withColumn("window_start", from_millis(own + F.col("period") * step))


def window_counts(df: DataFrame, keys: list[str], time: str = "ts", size: str = "10m", advance: str = "1m", value: Column | None = None, least_rows: bool = True) -> DataFrame:
    """period0, period1, …: the count (or the sum of value) of each period of each window, by keys.

    Rows are first aggregated to steps, so that the copies forward are of step totals, not of rows."""
    n = periods(size, advance)
    step = duration_ms(advance)
    measure = F.count(F.lit(1)) if value is None else F.sum(value)
    steps = df.groupBy(*keys, (F.floor(millis(time) / step).cast("bigint") * step).alias("_step")).agg(measure.alias("_v"))
    moved = steps.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_w", F.col("_step") + F.col("_p") * step)
    zero = F.lit(0) if value is None else F.lit(0.0)
    wide = moved.groupBy(*keys, "_w").agg(*[F.coalesce(F.sum(F.when(F.col("_p") == k, F.col("_v"))), zero).alias(f"period{k}") for k in range(n)])
    return wide.withColumn("window_start", from_millis("_w")).drop("_w").select(*keys, "window_start", *[f"period{k}" for k in range(n)])
