"""What the plans must show: filters and columns reach the scan, large sides aren't copied to all executors."""

from __future__ import annotations

from eventloom import catalog


def plan(spark, sf, name):
    return catalog.QUERIES[name](spark, sf)._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    shown = plan(spark, sf, "q_hourly_counts")
    assert "EqualNullSafe(event_type,purchase)" in shown
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in shown
    assert "GreaterThanOrEqual(ts" in plan(spark, sf, "q_time_range")
    assert "GreaterThanOrEqual(o_totalprice" in plan(spark, sf, "q_conditions")


def test_selection_is_limited_before_the_shuffle(spark, sf):
    shown = plan(spark, sf, "q_edge_rows")
    assert "WindowGroupLimit" in shown


def test_no_python_in_the_event_engine(spark, sf):
    for name in catalog.QUERIES:
        shown = plan(spark, sf, name)
        assert "MapInArrow" not in shown and "PythonUDF" not in shown and "CartesianProduct" not in shown, name
