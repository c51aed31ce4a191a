"""Sort keys of the event language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sort_key(order: str) -> Column:
    name, _, way = order.strip().partition(" ")
    down = way.strip().lower() in ("desc", "descending")
    return F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_first()


def general_sort_keys(column: str, descending: bool = False) -> list[Column]:
    """Numbers by value before texts without regard to case: 3, 20, 100, foo."""
    number, rest = F.col(column).try_cast("double"), F.lower(F.col(column).cast("string"))
    if descending:
        return [number.desc_nulls_first(), rest.desc_nulls_last()]
    return [F.col(column).isNotNull().asc(), number.asc_nulls_last(), rest.asc_nulls_first()]
