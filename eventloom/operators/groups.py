"""Nested groups, limits by depth, and rows picked from groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.selection import Pick

from .sorting import sort_key

#: Most rows by depth; the last size holds for all depths below.
DEFAULT_SIZES = (1_000_000, 100, 10, 1)


def size_at(sizes: Sequence[int], depth: int) -> int | None:
    """The limit of a depth; None if there is none."""
    return sizes[min(depth, len(sizes) - 1)] if sizes else None


def nested_groups(df: DataFrame, levels: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """One row for each group of each depth: depth 0 groups by the first level, depth 1 by the first two, and so on.
    Keys below a row's depth are null. One scan: the levels are the grouping sets of one aggregation."""
    sets = [list(levels[: d + 1]) for d in range(len(levels))]
    grouped = df.groupingSets(sets, *levels).agg(*[a.alias(n) for n, a in aggregates.items()], F.grouping_id().alias("_id"))
    depth = F.lit(len(levels) - 1) - F.bit_count(F.col("_id"))
    return grouped.select(depth.cast("int").alias("depth"), *levels, *aggregates)


def limit_by_depth(groups: DataFrame, levels: Sequence[str], order: Sequence[str], sizes: Sequence[int] = DEFAULT_SIZES) -> DataFrame:
    """At most sizes[depth] groups under each parent, and only those whose parents stay. Ties break by the keys."""
    kept: DataFrame | None = None
    for depth in range(len(levels)):
        own, most = groups.where(F.col("depth") == depth), size_at(sizes, depth)
        parents = list(levels[:depth])
        if kept is not None:
            above = kept.where(F.col("depth") == depth - 1).select(*[F.col(p).alias(f"_{p}") for p in parents])
            same = [own[p].eqNullSafe(above[f"_{p}"]) for p in parents]
            own = own.join(above, same, "left_semi")
        if most is not None:
            keys = [sort_key(o) for o in order] + [F.col(c).asc_nulls_first() for c in levels[: depth + 1]]
            if parents:
                rank = F.row_number().over(Window.partitionBy(*parents).orderBy(*keys))
                own = own.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
            else:
                own = own.orderBy(*keys).limit(most)
        kept = own if kept is None else kept.unionByName(own)
    return kept


def open_groups(groups: DataFrame, levels: Sequence[str], opened: Sequence[tuple]) -> DataFrame:
    """Depth 0, and the children of the opened groups (given by their keys)."""
    keep = F.col("depth") == 0
    for key in opened:
        same = F.col("depth") == len(key)
        for name, value in zip(levels, key, strict=False):
            same &= F.col(name).eqNullSafe(F.lit(value))
        keep |= same
    return groups.where(keep)


def edge_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int, last: bool = False) -> DataFrame:
    """The first (or last) n rows of each group, with their rank. Spark keeps n rows a group and task before it
    shuffles, so large groups are no burden."""
    by = [o if isinstance(o, Column) else sort_key(o) for o in order]
    if last:
        by = [sort_key(o + " desc") if isinstance(o, str) else o for o in order]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def edge_values(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], limit: int, last: bool = False) -> DataFrame:
    """(keys, values): the first (or last) values of each group in order, as an array of at most `limit`."""
    picked = edge_rows(df, keys, order, limit, last)
    held = F.array_sort(F.collect_list(F.struct((-F.col("rank") if last else F.col("rank")).alias("r"), F.col(value).alias("v"))))
    return picked.groupBy(*keys).agg(F.transform(held, lambda x: x["v"]).alias("values"))


def select_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], **picks: Pick) -> DataFrame:
    """(keys, picks): several selections in one pass. The rows at either end of a group that some pick needs are found
    by a rank with a limit, which Spark applies before it shuffles, so large groups are no burden; each end is ranked
    once, whatever the number of picks."""
    parts = []
    for last in (False, True):
        own = {n: p for n, p in picks.items() if p.last == last and not p.distinct}
        if not own:
            continue
        rows = edge_rows(df.select(*keys, *order, *{p.value for p in own.values()} - {*keys, *order}), keys, order, max(p.limit for p in own.values()), last)
        aggregates = []
        for name, p in own.items():
            if p.delimiter is None:
                aggregates.append(F.max(F.when(F.col("rank") == p.limit, F.struct(F.col(p.value).alias("v"))))["v"].alias(name))
                continue
            held = F.collect_list(F.when(F.col("rank") <= p.limit, F.struct((-F.col("rank") if last else F.col("rank")).alias("r"), F.col(p.value).cast("string").alias("v"))))
            aggregates.append(F.array_join(F.transform(F.array_sort(held), lambda x: x["v"]), p.delimiter).alias(name))
        parts.append(rows.groupBy(*keys).agg(*aggregates))
    parts += [distinct_values(df, keys, p.value, order, p.limit, p.delimiter or "", name) for name, p in picks.items() if p.distinct]
    return reduce(lambda a, b: same_groups(a, b, keys), parts).select(*keys, *picks)


def same_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two tables of one row a group side by side; null keys meet."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    return left.join(renamed, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])


def top_values(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], limit: int, delimiter: str, into: str, last: bool = False) -> DataFrame:
    """top(), or bottom() with last: the first or last values of each group, joined in order."""
    found = edge_values(df, keys, value, order, limit, last)
    return found.select(*keys, F.array_join(F.transform("values", lambda v: v.cast("string")), delimiter).alias(into))


def nth_value(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], n: int, into: str) -> DataFrame:
    """nth(): the nth value of each group, from 1, or null."""
    return edge_values(df, keys, value, order, n).select(*keys, F.try_element_at("values", F.lit(n)).alias(into))


def distinct_values(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], limit: int, delimiter: str, into: str) -> DataFrame:
    """distinct(): the first `limit` distinct values of each group in order, sorted and joined."""
    once = df.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_seen"))
    found = edge_values(once, keys, value, ["_seen"], limit)
    return found.select(*keys, F.array_join(F.array_sort(F.transform("values", lambda v: v.cast("string"))), delimiter).alias(into))


def nest(df: DataFrame, keys: Sequence[str], values: Sequence[str], most: Sequence[int]) -> DataFrame:
    """Chart data: values as an array of structs under each key, at most most[depth] at each depth, innermost first."""
    rows = df
    ordered = list(keys)
    inner = edge_rows(rows, ordered, [sort_key(v) for v in values], size_at(most, len(ordered))).drop("rank")
    nested = inner.groupBy(*ordered).agg(F.array_sort(F.collect_list(F.struct(*values))).alias("values"))
    while len(ordered) > 1:
        name = ordered.pop()
        picked = edge_rows(nested, ordered, [sort_key(name)], size_at(most, len(ordered))).drop("rank")
        nested = picked.groupBy(*ordered).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("key"), "values"))).alias("values"))
    return nested
