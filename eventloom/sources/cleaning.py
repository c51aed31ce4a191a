"""Cleaning and splitting raw texts, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.scalar import Arg, text
from eventloom.operators.conditions import tokens


def strip_bom(x: Arg) -> Column:
    return F.regexp_replace(text(x), "^﻿", "")


def drop_invalid_characters(x: Arg) -> Column:
    """Without control characters other than tab and line ends."""
    return F.regexp_replace(text(x), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def replace_invalid_xml_characters(x: Arg, replacement: str = "�") -> Column:
    return F.regexp_replace(text(x), r"[^\x09\x0A\x0D\x20-퟿-�\x{10000}-\x{10FFFF}]", replacement)


def escape_bad_xml_text(x: Arg) -> Column:
    """Ampersands that begin no entity, and angle brackets that begin no tag, become entities."""
    amp = F.regexp_replace(text(x), r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#\d+|#x[0-9A-Fa-f]+);)", "&amp;")
    return F.regexp_replace(amp, r"<(?![A-Za-z/!?])", "&lt;")


def find_replace(x: Arg, find: str, replacement: str, regex: bool = False, limit: int | None = None) -> Column:
    """Replaces a text or a pattern, everywhere or the first `limit` times, where it matches something."""
    import re

    pattern = find if regex else re.escape(find)
    into = replacement if regex else replacement.replace("\\", "\\\\").replace("$", "\\$")
    if limit is None:
        return F.regexp_replace(text(x), F.lit(pattern), F.lit(into))
    found = F.regexp_substr
    begin = F.struct(F.lit("").alias("done"), text(x).alias("rest"))

    def turn(so_far: Column, _: Column) -> Column:
        """Moves what ends with the first match of the rest over to what is done."""
        rest, match = so_far["rest"], found(so_far["rest"], F.lit(pattern))
        at = F.instr(rest, match)
        ahead = F.substring(rest, F.lit(1), at - 1)
        into_done = F.concat(so_far["done"], ahead, F.regexp_replace(match, F.lit(pattern), F.lit(into)))
        return F.when(F.coalesce(match, F.lit("")) == "", so_far).otherwise(F.struct(into_done.alias("done"), F.substr(rest, at + F.char_length(match)).alias("rest")))

    ended = F.aggregate(F.sequence(F.lit(1), F.lit(limit)), begin, turn)
    return F.concat(ended["done"], ended["rest"])


def split_fields(x: Arg, delimiter: str = ",", opens: str | None = None, closes: str | None = None, escape: str | None = None, least: int = 0, most: int | None = None) -> Column:
    """The fields of a line. Between the container characters `opens` and `closes` (one for both, if only one is given)
    delimiters don't part, and the container goes; after `escape` any character stands for itself. Fewer than `least`
    fields are no match (null); of more than `most` the first count."""
    code = lambda c: "".join(f"\\x{{{ord(k):x}}}" for k in c)
    d, any_ = code(delimiter), r"(?s:.)"
    escaped = f"{code(escape)}{any_}|" if escape else ""
    plain = f"(?:{escaped}(?!{d}){any_})*"
    closes = closes or opens
    field = f"(?:{code(opens)}(?:{escaped}(?!{code(closes)}){any_})*{code(closes)}|{plain})" if opens else plain
    fields = F.regexp_extract_all(F.concat(text(x), F.lit(delimiter)), F.lit(f"({field}){d}"), F.lit(1))

    def bare(f: Column) -> Column:
        if opens:
            f = F.when(F.startswith(f, F.lit(opens)) & F.endswith(f, F.lit(closes)) & (F.char_length(f) > 1), F.regexp_replace(f, f"(?s)^{any_}|{any_}$", "")).otherwise(f)
        return F.regexp_replace(f, f"{code(escape)}({any_})", "$1") if escape else f

    fields = F.transform(fields, bare)
    fields = F.when(F.size(fields) >= least, fields)
    return fields if most is None else F.slice(fields, 1, most)


def regex_matches(x: Arg, pattern: str, names: list[str], least: int = 0, most: int | None = None, ignore_case: bool = False, dot_all: bool = False) -> Column:
    """The groups of all matches, as an array of structs. Fewer than `least` are no match (null); of more than `most`
    the first count."""
    flagged = F.lit(("(?i)" if ignore_case else "") + ("(?s)" if dot_all else "") + pattern)
    found = F.arrays_zip(*[F.regexp_extract_all(text(x), flagged, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    found = F.when(F.size(found) >= least, found)
    return found if most is None else F.slice(found, 1, most)


def within(x: Arg, pattern: str, group: int, inner: Callable[[Column], Column]) -> Column:
    """A group node: what `inner` makes of each match of a group, as an array."""
    return F.transform(F.regexp_extract_all(text(x), F.lit(pattern), F.lit(group)), inner)


def remembered(df: DataFrame, stream: str, position: str, column: str, into: str) -> DataFrame:
    """A variable: the value that a record of the stream last stored, up to and including each record."""
    upto = Window.partitionBy(stream).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.last(column, ignorenulls=True).over(upto))


def combined_fields(x: Arg, names: list[str], xml_root: str = "/*") -> Column:
    """The combined parser: a text that begins with `{` is read as JSON, one with `<` as XML (fields are elements of the
    root), any other as key=value pairs. A struct of texts; empty where a field is missing."""
    start = F.substring(F.ltrim(text(x)), 1, 1)
    json = F.from_json(text(x), ", ".join(f"`{n}` string" for n in names))
    xml = _xpath_values(F.when(start == "<", text(x)), [f"{xml_root}/{n}" for n in names])
    pairs = key_values(F.when(~start.isin("{", "<"), text(x)))
    # xml first, where it is always evaluated, so that Spark evaluates it once for all fields; it is null for other texts
    return F.struct(*[F.coalesce(xml[i], F.when(start == "{", json[n]).otherwise(F.try_element_at(pairs, F.lit(n))), F.lit("")).alias(n) for i, n in enumerate(names)])


def chunked(df: DataFrame, stream: str, position: str, size: int, into: str = "chunk") -> DataFrame:
    """The split filter: numbers the chunks of `size` records of each stream, from 1."""
    place = F.row_number().over(Window.partitionBy(stream).orderBy(position))
    return df.withColumn(into, (F.floor((place - 1) / size) + 1).cast("int"))


def dynamic_fields(df: DataFrame, columns: list[str], into: str = "fields") -> DataFrame:
    """Any columns as one map from name to text, nulls left out: fields of an index, or of a result, without a schema."""
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), text(c).alias("v")) for c in columns]), lambda p: p["v"].isNotNull())
    return df.withColumn(into, F.map_from_entries(pairs))


def dynamic_terms(df: DataFrame, key: str, fields: str = "fields", analyser: str = "standard") -> DataFrame:
    """The dynamic index of a map of fields: (key, field, term), each once."""
    each = df.select(key, F.explode(fields).alias("field", "_value"))
    return each.select(key, "field", F.explode(tokens("_value", analyser)).alias("term")).distinct()


def split_quoted(x: Arg, delimiter: str = ",", quote: str = '"') -> Column:
    """The fields of a line; delimiters inside quotes don't part, and doubled quotes stand for one."""
    d, q = f"\\x{ord(delimiter):02x}", f"\\x{ord(quote):02x}"
    fields = F.regexp_extract_all(F.concat(text(x), F.lit(delimiter)), F.lit(rf"({q}(?:[^{q}]|{q}{q})*{q}|[^{d}]*){d}"), F.lit(1))
    return F.transform(fields, lambda f: F.when(F.startswith(f, F.lit(quote)), F.regexp_replace(F.regexp_replace(f, rf"^{q}|{q}$", ""), q + q, quote)).otherwise(f))


def split_records(df: DataFrame, column: str, delimiter: str = "\n", least: int = 0, most: int | None = None) -> DataFrame:
    """A row for each part of a text (empty ones left out), with record_no from 1; parts least+1 to most, if given."""
    parts = df.select("*", F.posexplode(F.filter(F.split(text(column), delimiter), lambda p: p != "")).alias("record_no", "record"))
    numbered = parts.withColumn("record_no", F.col("record_no") + 1).where(F.col("record_no") > least)
    return numbered if most is None else numbered.where(F.col("record_no") <= most)


def with_header(df: DataFrame, record: str, record_no: str, group: list[str], delimiter: str = ",") -> DataFrame:
    """Fields of the records of each group as a map, by the names in the group's first record."""
    heads = df.where(F.col(record_no) == 1).select(*group, split_quoted(record, delimiter).alias("_names"))
    rows = df.where(F.col(record_no) > 1).join(heads, group)
    return rows.withColumn("fields", F.map_from_arrays("_names", F.slice(split_quoted(record, delimiter), F.lit(1), F.size("_names")))).drop("_names")


def regex_fields(x: Arg, pattern: str, names: list[str], ignore_case: bool = False, dot_all: bool = False) -> Column:
    """The groups of the first match as a struct; null where the pattern doesn't match."""
    flagged = ("(?i)" if ignore_case else "") + ("(?s)" if dot_all else "") + pattern
    return F.when(text(x).rlike(flagged), F.struct(*[F.regexp_extract(text(x), flagged, i + 1).alias(n) for i, n in enumerate(names)]))


def key_values(x: Arg, pair: str = r"(\S+?)=(\S+)") -> Column:
    """All key and value pairs of a text as a map; of equal keys the last counts."""
    keys = F.regexp_extract_all(text(x), F.lit(pair), F.lit(1))
    values = F.regexp_extract_all(text(x), F.lit(pair), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys) + 1), p["k"]))
    return F.map_from_entries(last)


def _xpath_values(x: Column, paths: list[str]) -> Column:
    """The texts at some XPaths as an array, by one evaluation: each parses the whole text. What parts them can't stand
    in XML, not even as an entity."""
    parting = "\uffff"
    if len(paths) == 1:
        return F.array(F.xpath_string(x, F.lit(paths[0])))
    return F.split(F.xpath_string(x, F.lit("concat(" + f",'{parting}',".join(f"string({p})" for p in paths) + ")")), parting, -1)


def xml_fields(x: Arg, paths: dict[str, str]) -> Column:
    """Fields by XPath, as a struct of texts."""
    values = _xpath_values(text(x), list(paths.values()))
    return F.struct(*[values[i].alias(n) for i, n in enumerate(paths)])


def xml_fragment(x: Arg, root: str = "root") -> Column:
    """Fragments wrapped in one element."""
    return F.concat(F.lit(f"<{root}>"), text(x), F.lit(f"</{root}>"))


def json_fields(df: DataFrame, column: str, schema: str, bad: str = "_corrupt") -> DataFrame:
    """Fields of a JSON text; texts that don't fit keep their source in the `bad` column."""
    read = F.from_json(F.col(column), f"{schema}, {bad} string", {"columnNameOfCorruptRecord": bad})
    return df.withColumn("_j", read).select(*df.columns, "_j.*")


def with_event_ids(df: DataFrame, stream: str, position: str) -> DataFrame:
    """Adds event_id, from 1, by position in each stream. A stream is one file: its rows fit one task."""
    return df.withColumn("event_id", F.row_number().over(Window.partitionBy(stream).orderBy(position)))


def valid_records(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that meet a schema's condition, and those that don't."""
    ok = F.coalesce(condition, F.lit(False))
    return df.where(ok), df.where(~ok)


def with_output(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drops records that have no output: all of the columns null or empty."""
    return df.where(F.coalesce(*[F.nullif(text(c), F.lit("")) for c in columns]).isNotNull())


def counted(df: DataFrame, name: str) -> DataFrame:
    """Counts the rows that pass, for observers of that name."""
    return df.observe(name, F.count(F.lit(1)).alias("records"))
