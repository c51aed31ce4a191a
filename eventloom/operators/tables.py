"""Result tables: column filters, chosen values, paging, formats and row styles."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.dates import format_date
from eventloom.functions.scalar import Arg, col, text


def include_exclude(x: Arg, includes: str = "", excludes: str = "") -> Column:
    """Patterns, one a line, that may match anywhere: one include must (if there is any), no exclude may."""
    ins, outs = ([p for p in s.splitlines() if p.strip()] for s in (includes, excludes))
    found = lambda ps: reduce(lambda a, b: a | b, [F.coalesce(text(x).rlike(p), F.lit(False)) for p in ps])
    keep = found(ins) if ins else F.lit(True)
    return keep & ~found(outs) if outs else keep


def chosen_values(x: Arg, values: Sequence, invert: bool = False) -> Column:
    """Keeps the chosen values, or all others. Nothing chosen keeps no row, or all."""
    if not values:
        return F.lit(invert)
    hit = F.coalesce(col(x).isin(list(values)), F.lit(False))
    return ~hit if invert else hit


def page(df: DataFrame, order: Sequence[Column], offset: int, length: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(length)


def format_number(x: Arg, places: int = 0, separator: bool = False) -> Column:
    shown = F.format_number(col(x).cast("double"), places)
    return shown if separator else F.regexp_replace(shown, ",", "")


def format_column(x: Arg, kind: str = "general", **settings) -> Column:
    """General, number, date_time or text."""
    if kind == "number":
        return format_number(x, **settings)
    if kind == "date_time":
        return format_date(x, **settings)
    return text(x)


def style_rows(df: DataFrame, rules: Sequence[tuple[Column, str, bool]], into: str = "style") -> DataFrame:
    """The first rule (condition, style, hide) that holds styles a row or hides it."""
    style, hidden = F.lit(None).cast("string"), F.lit(False)
    for condition, name, hide in reversed(rules):
        holds = F.coalesce(condition, F.lit(False))
        style, hidden = F.when(holds, name).otherwise(style), F.when(holds, F.lit(hide)).otherwise(hidden)
    return df.withColumn(into, style).where(~hidden)


_PARAM = re.compile(r"\$\$|\$\{([^}]*)\}")


def substitute(template: str, params: dict[str, str]) -> str:
    """${name} becomes the parameter's value (empty if there is none), $$ a dollar sign."""
    return _PARAM.sub(lambda m: "$" if m[0] == "$$" else params.get(m[1].strip(), ""), template)


def read_params(line: str) -> dict[str, str]:
    """`user=jbloggs site="New York"` as a dictionary."""
    found = re.findall(r"""(\w[\w.\-]*)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|(\S+))""", line)
    return {k: re.sub(r"\\(.)", r"\1", a or b) or c for k, a, b, c in found}
