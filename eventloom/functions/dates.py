"""Dates and durations. Times are timestamps without zone, read as UTC; durations are milliseconds."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import Arg, col, text

UNITS = ("second", "minute", "hour", "day", "week", "month", "year")
#: What must have passed since a unit's start for a time to be rounded up: more than half of the unit.
HALVES = {"second": "500 milliseconds", "minute": "30 seconds", "hour": "30 minutes", "day": "12 hours", "week": "84 hours", "month": "15 days", "year": "6 months"}


def _ts(x: Arg) -> Column:
    return col(x).cast("timestamp_ntz")


def _checked(unit: str) -> str:
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    return unit


def floor_time(x: Arg, unit: str) -> Column:
    """The start of the unit (weeks begin on Monday)."""
    return F.date_trunc(_checked(unit), _ts(x)).cast("timestamp_ntz")


def ceiling_time(x: Arg, unit: str) -> Column:
    """The start of the next unit, or the time itself at a start."""
    start = floor_time(x, unit)
    return F.when(_ts(x) > start, start + F.expr(f"interval 1 {unit}")).otherwise(start)


def round_time(x: Arg, unit: str) -> Column:
    """The nearer start; exactly half rounds down."""
    start = floor_time(x, unit)
    return F.when(_ts(x) > start + F.expr(f"interval {HALVES[_checked(unit)]}"), start + F.expr(f"interval 1 {unit}")).otherwise(start)


def millis(x: Arg) -> Column:
    """Milliseconds since 1970."""
    return F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), _ts(x))


def from_millis(x: Arg) -> Column:
    return F.timestamp_add("MILLISECOND", col(x).cast("bigint"), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def parse_date(x: Arg, pattern: str | None = None) -> Column:
    """A text as a time, to the millisecond; null if it can't be read. Default: ISO 8601."""
    parsed = F.try_to_timestamp(text(x), F.lit(pattern)) if pattern else F.try_to_timestamp(text(x))
    return F.date_trunc("millisecond", parsed).cast("timestamp_ntz")


def format_date(x: Arg, pattern: str = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", zone: str = "UTC") -> Column:
    shown = _ts(x) if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), _ts(x))
    return F.date_format(shown, pattern)


_NAMED = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def parse_duration(x: Arg) -> Column:
    """Milliseconds of `1000`, `5m`, `1h`, `P2DT3H`; null if it can't be read. Fractions of a plain number are cut."""
    s = F.trim(text(x))
    amount = F.regexp_extract(s, r"^(\d+)\s*(ms|s|m|h|d|w)$", 1).try_cast("bigint")
    unit = F.regexp_extract(s, r"^(\d+)\s*(ms|s|m|h|d|w)$", 2)
    factor = F.try_element_at(F.create_map(*[F.lit(v) for pair in _NAMED.items() for v in pair]), unit)
    return F.coalesce(s.try_cast("double").cast("bigint"), amount * factor, parse_iso_duration(s))


def parse_iso_duration(x: Arg) -> Column:
    """Milliseconds of an ISO 8601 duration of days, hours, minutes and seconds."""
    pattern = r"^P(?!$)(?:(\d+)D)?(?:T(?=\d)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text(x), pattern, i), F.lit("")).cast("double"), F.lit(0.0))
    total = part(1) * 86_400_000 + part(2) * 3_600_000 + part(3) * 60_000 + part(4) * 1000
    return F.when(text(x).rlike(pattern), total.cast("bigint"))


def format_duration(x: Arg) -> Column:
    """Milliseconds in the largest unit that divides them: 1h, 22h, 5m."""
    ms = col(x).cast("bigint")
    shown = None
    for unit in ("d", "h", "m", "s"):
        size = _NAMED[unit]
        hit, value = (ms % size == 0) & (ms != 0), F.concat((ms / size).cast("bigint").cast("string"), F.lit(unit))
        shown = F.when(hit, value) if shown is None else shown.when(hit, value)
    return shown.otherwise(F.concat(ms.cast("string"), F.lit("ms")))


def format_iso_duration(x: Arg) -> Column:
    """Milliseconds as PT…: hours, minutes and seconds."""
    ms = col(x).cast("bigint")
    h, m, s = F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000), ms % 60_000 / 1000.0
    seconds = F.when(s == F.floor(s), F.floor(s).cast("string")).otherwise(F.regexp_replace(F.format_string("%.3f", s), "0+$", ""))
    body = F.concat(
        F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""),
        F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""),
        F.when(s > 0, F.concat(seconds, F.lit("S"))).otherwise(""),
    )
    return F.when(ms.isNotNull(), F.concat(F.lit("PT"), F.when(body == "", "0S").otherwise(body)))


# ---------------------------------------------------------------- relative dates, resolved once a query

_STEP = re.compile(r"\s*([+-]?)\s*(\d+)\s*(ms|[yMwdhms])")
_BASE = re.compile(r"\s*(?:(now|second|minute|hour|day|week|month|year)\(\)|(\d{4}-\d\d-\d\d(?:T\d\d:\d\d(?::\d\d(?:\.\d{1,6})?)?)?)Z?)", re.IGNORECASE)


def truncate(moment: datetime, unit: str) -> datetime:
    """The start of the unit that holds a moment."""
    whole = {"microsecond": 0, "second": 0, "minute": 0, "hour": 0, "day": 1, "month": 1}
    names = list(whole)
    if unit == "week":
        return truncate(moment, "day") - timedelta(days=moment.weekday())
    return moment.replace(**{k: whole[k] for k in names[: {"second": 1, "minute": 2, "hour": 3, "day": 4, "month": 5, "year": 6}[unit]]})


def _months(moment: datetime, n: int) -> datetime:
    months = moment.year * 12 + moment.month - 1 + n
    year, month = divmod(months, 12)
    last = [31, 29 if year % 4 == 0 and (year % 100 or year % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][month]
    return moment.replace(year=year, month=month + 1, day=min(moment.day, last))


def resolve_date(expression: str, reference: datetime | None = None) -> datetime:
    """A date expression such as `now() - 1d`, `day()` or `2015-02-03T01:22:33.056Z+2y-3d1h2s` as a UTC moment.
    A sign holds until the next one."""
    reference = reference or datetime.now(timezone.utc).replace(tzinfo=None)
    found = _BASE.match(expression)
    if not found:
        raise ValueError(f"not a date expression: {expression}")
    name, fixed = found.groups()
    if fixed:
        moment = datetime.fromisoformat(fixed)
    else:
        moment = reference if name.lower() == "now" else truncate(reference, name.lower())
    sign, at = 1, found.end()
    while at < len(expression.rstrip()):
        step = _STEP.match(expression, at)
        if not step:
            raise ValueError(f"not a date expression: {expression}")
        mark, amount, unit = step.groups()
        sign = {"+": 1, "-": -1, "": sign}[mark]
        n = sign * int(amount)
        if unit in "yM":
            moment = _months(moment, n * (12 if unit == "y" else 1))
        else:
            moment += timedelta(milliseconds=n * _NAMED[unit])
        at = step.end()
    return moment


def reference_time(unit: str | None = None, reference: datetime | None = None) -> Column:
    """now(), or the start of the current second, …, year: one moment for a whole query."""
    moment = reference or datetime.now(timezone.utc).replace(tzinfo=None)
    return F.lit((truncate(moment, unit) if unit else moment).isoformat()).cast("timestamp_ntz")
