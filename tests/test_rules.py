"""Detection rules on file streams."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventloom.functions import aggregates as a
from eventloom.streaming import rules

BASE = datetime(2024, 1, 1)
SCHEMA = "id bigint, ts timestamp, user string"


def write(spark, path, first, n):
    rows = [(i, BASE + timedelta(minutes=i), f"u{i % 3}") for i in range(first, first + n)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_streaming_rule_runs_on(spark, tmp_path):
    source, sink, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    write(spark, source, 0, 9)
    rule = rules.StreamingRule("u0", F.col("user") == "u0", "ts", ["id"])
    rule.start(rules.event_stream(spark, source, SCHEMA), sink, check).awaitTermination()
    assert spark.read.parquet(sink).count() == 3
    write(spark, source, 9, 3)
    rule.start(rules.event_stream(spark, source, SCHEMA), sink, check).awaitTermination()
    assert spark.read.parquet(sink).count() == 4


def test_streaming_rule_suppresses_duplicates(spark, tmp_path):
    source, sink, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    write(spark, source, 0, 9)
    rule = rules.StreamingRule("once", F.lit(True), "ts", ["user"], unique_by=["user"])
    rule.start(rules.event_stream(spark, source, SCHEMA), sink, check).awaitTermination()
    assert spark.read.parquet(sink).count() == 3


def test_table_builder_rule_keeps_totals(spark, tmp_path):
    source, sink, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    rule = rules.TableBuilderRule("busy", ["user"], {"n": a.count()}, F.col("n") > 3, "ts")
    write(spark, source, 0, 9)
    rule.start(rules.event_stream(spark, source, SCHEMA), sink, check).awaitTermination()
    write(spark, source, 9, 3)
    rule.start(rules.event_stream(spark, source, SCHEMA), sink, check).awaitTermination()
    found = spark.read.parquet(sink)
    assert sorted(r["values"][1]["value"] for r in found.collect()) == ["4", "4", "4"]


def test_schedule():
    w = rules.windows(BASE, BASE + timedelta(hours=3, minutes=5), timedelta(hours=1))
    assert len(w) == 3 and w[0][1] == w[1][0]


def test_cron():
    times = rules.cron_times("*/20 9-10 * * 1-5", datetime(2024, 1, 5, 9, 30), datetime(2024, 1, 8, 9, 30))
    assert times == [datetime(2024, 1, 5, 9, 40), *[datetime(2024, 1, 5, 10, m) for m in (0, 20, 40)], datetime(2024, 1, 8, 9, 0), datetime(2024, 1, 8, 9, 20)]
    assert rules.cron_times("0 0 0 1,15 * ?", BASE, datetime(2024, 2, 1)) == [datetime(2024, 1, 15), datetime(2024, 2, 1)]
    assert rules.cron_times("0 0 13 * 5", BASE, datetime(2024, 1, 14)) == [datetime(2024, 1, 5), datetime(2024, 1, 12), datetime(2024, 1, 13)]
    w = rules.cron_windows("0 * * * *", BASE, BASE + timedelta(hours=3, minutes=5))
    assert len(w) == 3 and w[0] == (BASE, BASE + timedelta(hours=1)) and w[0][1] == w[1][0]
    with pytest.raises(ValueError):
        rules.cron_times("61 * * * *", BASE, BASE)


def test_retention_needs_a_window():
    with pytest.raises(ValueError):
        rules.TableBuilderRule("r", ["user"], {"n": a.count()}, F.col("n") > 3, "ts", retention="1 day")


def test_linked_events_and_waiting(spark):
    df = spark.createDataFrame([(1, 7, BASE, "u"), (1, 8, BASE + timedelta(hours=5), "u")], "stream_id bigint, event_id bigint, ts timestamp_ntz, user string")
    rule = rules.StreamingRule("all", F.lit(True), "ts", ["user"], links=["stream_id", "event_id"])
    assert sorted(r["linked_events"][0]["event_id"] for r in rule.detections(df).collect()) == [7, 8]
    waits = rules.TableBuilderRule("w", ["user"], {"n": a.count()}, F.col("n") > 0, "ts", wait="2 hours")
    assert waits.settled(df, F.lit(BASE + timedelta(hours=6)).cast("timestamp_ntz")).count() == 1
