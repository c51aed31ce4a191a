"""The event language's functions as Column builders, and a register of them by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from . import aggregates, dates, scalar, selection, states

#: Builders by the language's names and aliases, in lower case. `of_row` forms take several arguments of one row.
FUNCTIONS: dict[str, Callable] = {
    # aggregates
    "average": aggregates.average,
    "mean": aggregates.average,
    "count": aggregates.count,
    "countgroups": aggregates.count_groups,
    "countunique": aggregates.count_unique,
    "max": aggregates.highest,
    "min": aggregates.lowest,
    "period": aggregates.in_period,
    "stdev": aggregates.st_dev,
    "sum": aggregates.total,
    "variance": aggregates.variance,
    # casts
    "toboolean": scalar.to_boolean,
    "todouble": scalar.to_double,
    "tofloat": scalar.to_float,
    "tointeger": scalar.to_integer,
    "tolong": scalar.to_long,
    "tostring": scalar.to_string,
    # dates
    **{f"{way}{unit}": partial(do, unit=unit) for way, do in (("floor", dates.floor_time), ("ceiling", dates.ceiling_time), ("round", dates.round_time)) for unit in dates.UNITS},
    **{unit: partial(dates.reference_time, unit) for unit in dates.UNITS},
    "now": dates.reference_time,
    "formatdate": dates.format_date,
    "parsedate": dates.parse_date,
    "formatduration": dates.format_duration,
    "formatisoduration": dates.format_iso_duration,
    "parseduration": dates.parse_duration,
    "parseisoduration": dates.parse_iso_duration,
    # links
    "dashboard": scalar.dashboard_link,
    "data": scalar.data_link,
    "link": scalar.link,
    "stepping": scalar.stepping_link,
    # logic
    "and": scalar.and_,
    "or": scalar.or_,
    "not": scalar.not_,
    "if": scalar.if_,
    **dict.fromkeys(("=", "equals", "eq"), scalar.equals),
    **dict.fromkeys(("!=", "notequals", "ne"), scalar.not_equals),
    **dict.fromkeys((">", "greaterthan", "gt"), scalar.greater_than),
    **dict.fromkeys((">=", "greaterthanorequalto", "gte"), scalar.greater_than_or_equal_to),
    **dict.fromkeys(("<", "lessthan", "lt"), scalar.less_than),
    **dict.fromkeys(("<=", "lessthanorequalto", "lte"), scalar.less_than_or_equal_to),
    # mathematics
    **dict.fromkeys(("+", "add"), scalar.add),
    **dict.fromkeys(("-", "subtract"), scalar.subtract),
    **dict.fromkeys(("*", "multiply"), scalar.multiply),
    **dict.fromkeys(("/", "divide"), scalar.divide),
    **dict.fromkeys(("%", "mod", "modulo"), scalar.modulo),
    **dict.fromkeys(("^", "power"), scalar.power),
    "ceiling": scalar.ceiling,
    "floor": scalar.floor,
    "round": scalar.round_half_up,
    "negate": scalar.negate,
    "random": scalar.random,
    # parameters and the user
    **dict.fromkeys(("currentuser", "currentuserdisplayname", "currentuserfullname", "currentusersubjectid", "currentuseruuid"), scalar.current_user),
    "param": scalar.param,
    "params": scalar.params,
    "getstate": states.get_state,
    # selection
    "any": aggregates.any_value,
    "bottom": selection.bottom,
    "first": aggregates.first,
    "last": aggregates.last,
    "nth": selection.nth,
    "top": selection.top,
    "joining": selection.joining,
    "distinct": selection.distinct,
    # text
    "concat": scalar.concat,
    "contains": scalar.contains,
    "decodeurl": scalar.decode_url,
    "encodeurl": scalar.encode_url,
    "exclude": scalar.exclude,
    "include": scalar.include,
    "indexof": scalar.index_of,
    "lastindexof": scalar.last_index_of,
    "lowercase": scalar.lower_case,
    "uppercase": scalar.upper_case,
    "match": scalar.match,
    "replace": scalar.replace,
    "stringlength": scalar.string_length,
    "substring": scalar.substring,
    "substringafter": scalar.substring_after,
    "substringbefore": scalar.substring_before,
    "hash": scalar.hash_text,
    # types
    **{f"is{name}": partial(scalar.is_type, name=name) for name in ("boolean", "double", "integer", "long", "string")},
    "iserror": scalar.is_error,
    "isnull": scalar.is_null,
    "isnumber": scalar.is_number,
    "isvalue": scalar.is_value,
    "typeof": scalar.type_of,
    # URIs
    "extractauthorityfromuri": scalar.authority_from_uri,
    "extractfragmentfromuri": scalar.fragment_from_uri,
    "extracthostfromuri": scalar.host_from_uri,
    "extractpathfromuri": scalar.path_from_uri,
    "extractportfromuri": scalar.port_from_uri,
    "extractqueryfromuri": scalar.query_from_uri,
    "extractschemefromuri": scalar.scheme_from_uri,
    "extractschemespecificpartfromuri": scalar.scheme_specific_part_from_uri,
    "extractuserinfofromuri": scalar.user_info_from_uri,
    # values
    "true": partial(scalar.lit, True),
    "false": partial(scalar.lit, False),
    "null": partial(scalar.lit, None),
    "err": partial(scalar.lit, None),
}


def function(name: str) -> Callable:
    """The builder of a function, by its name in any case."""
    return FUNCTIONS[name.lower()]
