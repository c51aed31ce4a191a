"""Group functions as aggregate Columns. Where the result depends on the order of rows, the order is an argument."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import Arg, col, num, text


def count() -> Column:
    return F.count(F.lit(1))


def count_unique(*xs: Arg) -> Column:
    """Distinct values, nulls left out."""
    return F.count_distinct(*[col(x) for x in xs])


def count_groups(*keys: Arg) -> Column:
    """Distinct groups of the next level; null if there are none. Null keys make a group too."""
    n = F.count_distinct(F.struct(*[F.coalesce(text(k), F.lit("\0")) for k in keys]))
    return F.when(n > 0, n)


def average(x: Arg) -> Column:
    """The sum over the number of all rows, those with a null included."""
    return F.sum(num(x)) / F.count(F.lit(1))


def total(x: Arg) -> Column:
    return F.sum(num(x))


def highest(x: Arg) -> Column:
    return F.max(num(x))


def lowest(x: Arg) -> Column:
    return F.min(num(x))


def variance(x: Arg) -> Column:
    """Of the whole population."""
    return F.var_pop(num(x))


def st_dev(x: Arg) -> Column:
    return F.stddev_pop(num(x))


def in_period(period: Arg, k: int, value: Arg) -> Column:
    """The value in rows of period k, null in others: the argument for an aggregate over one period of a window."""
    return F.when(col(period) == k, col(value))


# ---------------------------------------------------------------- the same names over several arguments of a row


def row_average(*xs: Arg) -> Column:
    return reduce(lambda a, b: a + b, [num(x) for x in xs]) / len(xs)


def row_sum(*xs: Arg) -> Column:
    return reduce(lambda a, b: a + b, [num(x) for x in xs])


def row_max(*xs: Arg) -> Column:
    return F.greatest(*[num(x) for x in xs])


def row_min(*xs: Arg) -> Column:
    return F.least(*[num(x) for x in xs])


def row_variance(*xs: Arg) -> Column:
    mean = row_average(*xs)
    return reduce(lambda a, b: a + b, [(num(x) - mean) * (num(x) - mean) for x in xs]) / len(xs)


def row_st_dev(*xs: Arg) -> Column:
    return F.sqrt(row_variance(*xs))


# ---------------------------------------------------------------- selection


def any_value(x: Arg, order: Arg) -> Column:
    """The last value that isn't null."""
    return F.max_by(col(x), F.when(col(x).isNotNull(), col(order)))


def first(x: Arg, order: Arg) -> Column:
    """The first value, null or not."""
    return F.min_by(F.struct(col(x).alias("x")), col(order))["x"]


def last(x: Arg, order: Arg) -> Column:
    return F.max_by(F.struct(col(x).alias("x")), col(order))["x"]


def _in_order(x: Arg, order: Arg) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(col(order).alias("o"), col(x).alias("x")))), lambda v: v["x"])


def nth(x: Arg, n: int, order: Arg) -> Column:
    """The nth value, from 1. It gathers the group's values: for large groups use groups.nth_value()."""
    return F.try_element_at(_in_order(x, order), F.lit(n))


def top(x: Arg, delimiter: str, limit: int, order: Arg) -> Column:
    """The first values in order, joined (gathers the group; groups.top_values() doesn't)."""
    return F.array_join(F.slice(_in_order(text(x), order), 1, limit), delimiter)


def bottom(x: Arg, delimiter: str, limit: int, order: Arg) -> Column:
    """The last values, still in order, joined (gathers the group; groups.top_values() doesn't)."""
    values = _in_order(text(x), order)
    return F.array_join(F.slice(values, F.greatest(F.lit(1), F.size(values) - limit + 1), limit), delimiter)


def joining(x: Arg, delimiter: str = "", limit: int = 10, order: Arg | None = None) -> Column:
    """The first `limit` values in order, joined (gathers the group; groups.top_values() doesn't)."""
    return top(x, delimiter, limit, order if order is not None else x)


def distinct(x: Arg, delimiter: str = "", limit: int = 10, order: Arg | None = None) -> Column:
    """The first `limit` distinct values in order, sorted and joined (gathers the group; groups.distinct_values() doesn't)."""
    seen = F.slice(F.array_distinct(_in_order(text(x), order if order is not None else x)), 1, limit)
    return F.array_join(F.array_sort(seen), delimiter)
