"""Every registered query of the event engine against its SQL."""

from __future__ import annotations

import pytest
from oracle import differences

from eventloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf, name):
    assert name in catalog.ORACLE_SQL
    assert differences(spark, sf, catalog.QUERIES[name], catalog.ORACLE_SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["hour", "n"]
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
