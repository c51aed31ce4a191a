"""Selections from the rows of a group: what top(), bottom(), nth(), joining() and distinct() ask for.

They are no aggregate Columns, which would gather whole groups: EventQuery.group_by() finds them by ranks with a limit,
in the order given by EventQuery.order()."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pick:
    """A selection from a group in order: the first (or last) `limit` values joined by the delimiter, the nth value
    (nth), the first (last) one (limit 1 without a delimiter), or the first distinct ones, sorted and joined."""

    value: str
    limit: int
    delimiter: str | None = None
    last: bool = False
    nth: bool = False
    distinct: bool = False


def top(value: str, delimiter: str, limit: int) -> Pick:
    return Pick(value, limit, delimiter)


def bottom(value: str, delimiter: str, limit: int) -> Pick:
    return Pick(value, limit, delimiter, last=True)


def nth(value: str, n: int) -> Pick:
    return Pick(value, n, nth=True)


def joining(value: str, delimiter: str = "", limit: int = 10) -> Pick:
    return Pick(value, limit, delimiter)


def distinct(value: str, delimiter: str = "", limit: int = 10) -> Pick:
    return Pick(value, limit, delimiter, distinct=True)
