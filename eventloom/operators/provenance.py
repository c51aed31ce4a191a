"""Where records come from: attributes of their streams, and their places in the source text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_meta(df: DataFrame, attributes: DataFrame, stream: str, names: dict[str, str]) -> DataFrame:
    """Adds stream attributes, as meta(), feed-name(), pipeline-name(), partition and the like do: names maps new
    columns to attributes. attributes: (stream, name, value) rows; of a repeated attribute the greatest value counts.
    Records of unknown streams get nulls."""
    picked = attributes.where(F.col("name").isin(sorted(set(names.values()))) & F.col(stream).isNotNull())
    wide = picked.groupBy(F.col(stream).alias("_stream")).agg(*[F.max(F.when(F.col("name") == of, F.col("value"))).alias(into) for into, of in names.items()])
    return df.join(wide, df[stream] == wide["_stream"], "left").drop("_stream")


def with_classification(df: DataFrame, feeds: DataFrame, feed: str, default: str, into: str = "classification") -> DataFrame:
    """Adds the security label of each record's feed; feeds: (feed, classification), the default where there is none."""
    labels = feeds.groupBy(F.col("feed").alias("_feed")).agg(F.max("classification").alias("_label"))
    return df.join(labels, df[feed] == labels["_feed"], "left").withColumn(into, F.coalesce("_label", F.lit(default))).drop("_feed", "_label")


def with_positions(records: DataFrame, stream: str, position: str, record: str, delimiter: str = "\n") -> DataFrame:
    """Adds line_from, col_from, line_to and col_to, from 1, of records that were split at a delimiter: the places of a
    record's first and last character. An empty record ends where it begins. A stream is one file: its rows fit a task."""
    order = Window.partitionBy(stream).orderBy(position)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    breaks: Column = F.regexp_count(F.col(record), F.lit("\n"))
    whole = F.concat(F.col(record), F.lit(delimiter))
    tail = F.char_length(F.substring_index(whole, "\n", -1))  # behind the last line end, or all
    out = records.withColumns({"_tail": tail, "_broken": F.contains(whole, F.lit("\n"))})
    out = out.withColumns({"_line": F.coalesce(F.sum(breaks + delimiter.count("\n")).over(before), F.lit(0)), "_sum": F.coalesce(F.sum("_tail").over(before), F.lit(0))})
    # characters since the last line end: tails from the row that holds it on
    out = out.withColumn("_since", F.coalesce(F.last(F.when(F.col("_broken"), F.col("_sum")), ignorenulls=True).over(before), F.lit(0)))
    column = F.col("_sum") - F.col("_since") + 1
    length = F.char_length(record)
    end = F.when(breaks > 0, F.char_length(F.substring_index(F.col(record), "\n", -1))).otherwise(F.greatest(column, column + length - 1))
    out = out.withColumns({"line_from": (F.col("_line") + 1).cast("long"), "col_from": column.cast("long"), "line_to": (F.col("_line") + breaks + 1).cast("long"), "col_to": end.cast("long")})
    return out.drop("_tail", "_broken", "_line", "_sum", "_since")
