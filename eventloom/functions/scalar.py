"""Row functions over Columns: mathematics, logic, text, casts, types, URIs and links.

Arguments are Columns or column names; plain numbers and texts go through lit(). A function that the event language
would give an error value for (a division by zero, a bad cast, a bad URI) gives null here; is_error() tells such nulls
from nulls that came in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Arg = Column | str

# ---------------------------------------------------------------- helpers


def col(x: Arg) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit(x: object) -> Column:
    return F.lit(x)


def num(x: Arg) -> Column:
    return col(x).try_cast("double")


def text(x: Arg) -> Column:
    return col(x).cast("string")


def _all(args: tuple[Arg, ...], least: int, name: str) -> list[Column]:
    if len(args) < least:
        raise ValueError(f"{name} needs {least} arguments or more")
    return [col(x) for x in args]


# ---------------------------------------------------------------- mathematics


def add(*args: Arg) -> Column:
    """Sum of the arguments; nulls count as 0, all null gives null."""
    xs = [num(x) for x in _all(args, 2, "add")]
    return F.when(F.coalesce(*xs).isNotNull(), reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in xs]))


def add_text(*args: Arg) -> Column:
    """What + does as soon as one argument is a text: the arguments one after the other, nulls left out."""
    return F.concat(*[F.coalesce(text(x), F.lit("")) for x in _all(args, 2, "add_text")])


def subtract(*args: Arg) -> Column:
    return reduce(lambda a, b: a - b, [num(x) for x in _all(args, 2, "subtract")])


def multiply(*args: Arg) -> Column:
    return reduce(lambda a, b: a * b, [num(x) for x in _all(args, 2, "multiply")])


def divide(*args: Arg) -> Column:
    """Divides by each further argument in turn; by zero gives null."""
    return reduce(F.try_divide, [num(x) for x in _all(args, 2, "divide")])


def modulo(*args: Arg) -> Column:
    """The remainder by each further argument in turn; by zero gives null."""
    return reduce(F.try_mod, [num(x) for x in _all(args, 2, "modulo")])


def power(*args: Arg) -> Column:
    """To the power of each further argument in turn: power(2, 4, 3) is 4096."""
    return reduce(F.pow, [num(x) for x in _all(args, 2, "power")])


def negate(x: Arg) -> Column:
    return -num(x)


def _scaled(x: Arg, places: int, to_whole) -> Column:
    return to_whole(num(x) * float(10**places)).cast("double") / float(10**places)


def ceiling(x: Arg, places: int = 0) -> Column:
    return _scaled(x, places, F.ceil)


def floor(x: Arg, places: int = 0) -> Column:
    return _scaled(x, places, F.floor)


def round_half_up(x: Arg, places: int = 0) -> Column:
    """Halves go towards positive infinity: -2.5 becomes -2."""
    return _scaled(x, places, lambda v: F.floor(v + 0.5))


def random() -> Column:
    return F.rand()


# ---------------------------------------------------------------- logic: two-valued comparisons


def equals(a: Arg, b: Arg) -> Column:
    """Two nulls are equal."""
    return F.equal_null(col(a), col(b))


def equals_number(a: Arg, b: Arg, tolerance: float = 1e-5) -> Column:
    """Equality of floating numbers, within a tolerance; two nulls are equal."""
    x, y = num(a), num(b)
    return F.coalesce(F.abs(x - y) < tolerance, x.isNull() & y.isNull())


def not_equals(a: Arg, b: Arg) -> Column:
    return ~equals(a, b)


def greater_than(a: Arg, b: Arg) -> Column:
    return col(a).isNotNull() & col(b).isNotNull() & (col(a) > col(b))


def less_than(a: Arg, b: Arg) -> Column:
    return col(a).isNotNull() & col(b).isNotNull() & (col(a) < col(b))


def greater_than_or_equal_to(a: Arg, b: Arg) -> Column:
    return F.coalesce(col(a) >= col(b), col(a).isNull() & col(b).isNull())


def less_than_or_equal_to(a: Arg, b: Arg) -> Column:
    return F.coalesce(col(a) <= col(b), col(a).isNull() & col(b).isNull())


def and_(*args: Arg) -> Column:
    """Nulls count as false."""
    return reduce(lambda a, b: a & b, [F.coalesce(x.cast("boolean"), F.lit(False)) for x in _all(args, 2, "and")])


def or_(*args: Arg) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(x.cast("boolean"), F.lit(False)) for x in _all(args, 2, "or")])


def not_(x: Arg) -> Column:
    """Null stays null."""
    return ~col(x).try_cast("boolean")


def if_(condition: Arg, then: Arg, otherwise: Arg) -> Column:
    """A null condition gives null."""
    c = col(condition).try_cast("boolean")
    return F.when(c, col(then)).when(~c, col(otherwise))


# ---------------------------------------------------------------- casts


def to_boolean(x: Arg) -> Column:
    return F.coalesce(col(x).try_cast("boolean"), num(x) != 0)


def to_double(x: Arg) -> Column:
    return col(x).try_cast("double")


def to_float(x: Arg) -> Column:
    return col(x).try_cast("float")


def to_integer(x: Arg) -> Column:
    return col(x).try_cast("int")


def to_long(x: Arg) -> Column:
    return col(x).try_cast("bigint")


def to_string(x: Arg) -> Column:
    return text(x)


# ---------------------------------------------------------------- text


def concat(*args: Arg) -> Column:
    return F.concat(*[F.coalesce(text(x), F.lit("")) for x in args])


def contains(x: Arg, part: Arg) -> Column:
    return F.contains(text(x), text(part))


def decode_url(x: Arg) -> Column:
    return F.try_url_decode(text(x))


def encode_url(x: Arg) -> Column:
    return F.url_encode(text(x))


def _whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def match(x: Arg, pattern: str) -> Column:
    """Whether the whole text matches."""
    return text(x).rlike(_whole(pattern))


def include(x: Arg, *patterns: str) -> Column:
    """The text if it matches one of the patterns as a whole, else null."""
    return F.when(reduce(lambda a, b: a | b, [match(x, p) for p in patterns]), text(x))


def exclude(x: Arg, *patterns: str) -> Column:
    """The text if it matches none of the patterns as a whole, else null."""
    return F.when(~reduce(lambda a, b: a | b, [match(x, p) for p in patterns]), text(x))


def replace(x: Arg, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text(x), F.lit(pattern), F.lit(replacement))


def index_of(x: Arg, part: Arg) -> Column:
    """The first place, from 0, or -1."""
    return F.position(text(part), text(x)) - 1


def last_index_of(x: Arg, part: str) -> Column:
    """The last place, from 0, or -1."""
    at = F.position(F.lit(part[::-1]), F.reverse(text(x)))
    return F.when(at == 0, -1).otherwise(F.length(text(x)) - len(part) - (at - 1))


def string_length(x: Arg) -> Column:
    return F.length(text(x))


def lower_case(x: Arg) -> Column:
    return F.lower(text(x))


def upper_case(x: Arg) -> Column:
    return F.upper(text(x))


def substring(x: Arg, start: int | Arg, end: int | Arg) -> Column:
    """Characters from start (from 0) to before end; places outside the text give what is inside, or an empty text."""
    s, n = text(x), F.length(text(x))
    a, b = (F.lit(v) if isinstance(v, int) else col(v) for v in (start, end))
    bad = (a < 0) | (b < a) | (a >= n)
    return F.when(bad, "").otherwise(F.substr(s, a + 1, F.least(b, n) - a))


def substring_before(x: Arg, delimiter: str) -> Column:
    """The part before the first delimiter; empty if there is none."""
    at = F.instr(text(x), F.lit(delimiter))
    return F.when(at > 0, F.substr(text(x), F.lit(1), at - 1)).when(at == 0, "")


def substring_after(x: Arg, delimiter: str) -> Column:
    """The part after the first delimiter; empty if there is none."""
    at = F.instr(text(x), F.lit(delimiter))
    return F.when(at > 0, F.substr(text(x), at + len(delimiter))).when(at == 0, "")


def hash_text(x: Arg, algorithm: str = "sha-256", salt: str = "") -> Column:
    """The digest of the salt followed by the text, in hexadecimal."""
    salted = F.concat(F.lit(salt), text(x))
    ways = {
        "md5": lambda v: F.md5(v),
        "sha-1": lambda v: F.sha1(v),
        "sha-256": lambda v: F.sha2(v, 256),
        "sha-512": lambda v: F.sha2(v, 512),
    }
    return ways[algorithm.lower()](salted)


# ---------------------------------------------------------------- query parameters and the user


def param(name: str, params: dict[str, str]) -> Column:
    return F.lit(params.get(name))


def params(values: dict[str, str]) -> Column:
    return F.lit(" ".join(f"{k}={v}" for k, v in values.items()))


def current_user(name: str | None = None) -> Column:
    return F.lit(name) if name is not None else F.current_user()


# ---------------------------------------------------------------- types

# fixed values: the language's names of the types
TYPE_NAMES = {
    "boolean": "boolean",
    "float": "float",
    "double": "double",
    "tinyint": "integer",
    "smallint": "integer",
    "int": "integer",
    "bigint": "long",
    "date": "date",
    "timestamp": "date",
    "timestamp_ntz": "date",
    "string": "string",
    "interval day to second": "duration",
}
NUMBER_TYPES = ("float", "double", "integer", "long", "date", "duration")


def _named(x: Arg) -> Column:
    kind = F.typeof(col(x))
    known = F.create_map(*[F.lit(v) for pair in TYPE_NAMES.items() for v in pair])
    return F.coalesce(F.try_element_at(known, kind), F.lit("string"))


def type_of(x: Arg) -> Column:
    return F.when(col(x).isNull(), "null").otherwise(_named(x))


def is_type(x: Arg, name: str) -> Column:
    return col(x).isNotNull() & (_named(x) == name)


def is_number(x: Arg) -> Column:
    return col(x).isNotNull() & _named(x).isin(*NUMBER_TYPES)


def is_null(x: Arg) -> Column:
    return col(x).isNull()


def is_value(x: Arg) -> Column:
    return col(x).isNotNull()


def is_error(result: Arg, *inputs: Arg) -> Column:
    """Null although none of the inputs is."""
    return reduce(lambda a, b: a & b, [col(x).isNotNull() for x in inputs], col(result).isNull())


# ---------------------------------------------------------------- URIs


def _uri(part: str):
    def of(x: Arg) -> Column:
        return F.try_parse_url(text(x), F.lit(part))

    of.__doc__ = f"The {part} of a URI."
    return of


authority_from_uri = _uri("AUTHORITY")
fragment_from_uri = _uri("REF")
host_from_uri = _uri("HOST")
path_from_uri = _uri("PATH")
query_from_uri = _uri("QUERY")
scheme_from_uri = _uri("PROTOCOL")
user_info_from_uri = _uri("USERINFO")


def port_from_uri(x: Arg) -> Column:
    """The port as a text; -1 without one."""
    port = F.regexp_extract(authority_from_uri(x), r":(\d+)$", 1)
    return F.when(text(x).isNotNull(), F.when(F.coalesce(port, F.lit("")) == "", "-1").otherwise(port))


def scheme_specific_part_from_uri(x: Arg) -> Column:
    return F.regexp_extract(text(x), r"^[^:]+:([^#]*)", 1)


# ---------------------------------------------------------------- links: [text](url){type}


def link(label: Arg, url: Arg, kind: str | None = None) -> Column:
    shown = F.concat(F.lit("["), F.url_encode(text(label)), F.lit("]("), F.url_encode(text(url)), F.lit(")"))
    return F.concat(shown, F.lit("{" + kind + "}")) if kind else shown


def dashboard_link(label: Arg, uuid: Arg, parameters: Arg | None = None) -> Column:
    url = F.concat(F.lit("?uuid="), text(uuid))
    return link(label, url if parameters is None else F.concat(url, F.lit("&params="), text(parameters)), "dashboard")


def stepping_link(label: Arg, *ids: Arg) -> Column:
    parts = [F.concat(F.lit(f"{'&' if i else '?'}{name}="), text(x)) for i, (name, x) in enumerate(zip(("id", "partNo", "recordNo"), ids, strict=False))]
    return link(label, F.concat(*parts), "stepping")


def data_link(label: Arg, **parts: Arg) -> Column:
    built = [F.concat(F.lit(f"{'&' if i else '?'}{name}="), text(x)) for i, (name, x) in enumerate(parts.items())]
    return link(label, F.concat(*built), "data")


# ---------------------------------------------------------------- record functions of ingestion


def numeric_ip(x: Arg) -> Column:
    """A dotted IPv4 address as a number; null if it isn't one."""
    parts = F.split(text(x), r"\.")
    byte = [F.try_element_at(parts, F.lit(i)).try_cast("bigint") for i in (1, 2, 3, 4)]
    ok = (F.size(parts) == 4) & reduce(lambda a, b: a & b, [b.between(0, 255) for b in byte])
    return F.when(ok, reduce(lambda a, b: a * 256 + b, byte))


def cidr_range(x: Arg) -> Column:
    """(lo, hi) of a CIDR block."""
    bits = F.try_element_at(F.split(text(x), "/"), F.lit(2)).try_cast("int")
    size = F.pow(F.lit(2.0), 32 - bits).cast("bigint")
    base = numeric_ip(F.element_at(F.split(text(x), "/"), 1))
    lo = base - F.pmod(base, size)
    return F.when(bits.between(0, 32) & base.isNotNull(), F.struct(lo.alias("lo"), (lo + size - 1).alias("hi")))


def ip_in_cidr(ip: Arg, cidr: Arg) -> Column:
    block = cidr_range(cidr)
    return numeric_ip(ip).between(block["lo"], block["hi"])


def hex_to_dec(x: Arg) -> Column:
    return F.conv(text(x), 16, 10)


def hex_to_oct(x: Arg) -> Column:
    return F.conv(text(x), 16, 8)


def hex_to_string(x: Arg, charset: str = "UTF-8") -> Column:
    return F.decode(F.unhex(F.regexp_replace(text(x), r"\s", "")), charset)


def json_to_xml(x: Arg, schema: str) -> Column:
    return F.to_xml(F.from_json(text(x), schema))
