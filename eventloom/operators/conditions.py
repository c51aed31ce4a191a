"""Predicates on Columns, with the matching rules of indexed fields.

All are true or false, never null, and comparisons keep a form that Spark pushes into the scan.

all_of / any_of / none_of leave out terms that are None (disabled); without a term left they hold for every row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.scalar import Arg, col, ip_in_cidr, text

ANALYSERS = {
    "keyword": None,
    "alpha": r"[^\p{L}]+",
    "numeric": r"[^\p{N}]+",
    "alpha_numeric": r"[^\p{L}\p{N}]+",
    "whitespace": r"\s+",
    "standard": r"[^\p{L}\p{N}_']+",
    "stop": r"[^\p{L}]+",
}
# fixed values: the stop words that the stop analyser leaves out
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()


def wildcard_pattern(value: str) -> str:
    """`*` and `?` as a regular expression for a whole text."""
    return r"(?s)\A" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in value) + r"\z"


def equals(x: Arg, value: object, case_sensitive: bool = False) -> Column:
    """Texts ignore case unless told otherwise and may hold `*` and `?`; other values are compared as they are."""
    if not isinstance(value, str):
        return col(x).eqNullSafe(F.lit(value))
    if "*" in value or "?" in value:
        return F.coalesce(text(x).rlike(("" if case_sensitive else "(?i)") + wildcard_pattern(value)), F.lit(False))
    return text(x).eqNullSafe(F.lit(value)) if case_sensitive else F.lower(text(x)).eqNullSafe(F.lit(value.lower()))


def not_equals(x: Arg, value: object) -> Column:
    return ~equals(x, value)


def contains(x: Arg, value: str) -> Column:
    """Whether the text occurs, in any case; it may hold `*` and `?`."""
    if "*" in value or "?" in value:
        return equals(x, f"*{value}*")
    return F.coalesce(F.contains(F.lower(text(x)), F.lit(value.lower())), F.lit(False))


def starts_with(x: Arg, value: str) -> Column:
    return text(x).isNotNull() & F.startswith(text(x), F.lit(value))


def ends_with(x: Arg, value: str) -> Column:
    return text(x).isNotNull() & F.endswith(text(x), F.lit(value))


def matches(x: Arg, pattern: str) -> Column:
    return F.coalesce(text(x).rlike(pattern), F.lit(False))


def greater_than(x: Arg, value: object) -> Column:
    return col(x).isNotNull() & (col(x) > F.lit(value))


def greater_than_or_equal_to(x: Arg, value: object) -> Column:
    return col(x).isNotNull() & (col(x) >= F.lit(value))


def less_than(x: Arg, value: object) -> Column:
    return col(x).isNotNull() & (col(x) < F.lit(value))


def less_than_or_equal_to(x: Arg, value: object) -> Column:
    return col(x).isNotNull() & (col(x) <= F.lit(value))


def is_null(x: Arg) -> Column:
    return col(x).isNull()


def is_not_null(x: Arg) -> Column:
    return col(x).isNotNull()


def is_doc_ref(x: Arg, uuid: str) -> Column:
    """Whether a document reference (a struct of type, uuid and name) is that document: the UUID alone tells."""
    return F.coalesce(col(x)["uuid"] == uuid, F.lit(False))


def of_doc_ref(x: Arg, kind: str, uuid: str | None = None) -> Column:
    """Whether a document reference is of a type, and of one document of it if a UUID is given."""
    same = col(x)["type"] == kind
    return F.coalesce(same if uuid is None else same & (col(x)["uuid"] == uuid), F.lit(False))


def between(x: Arg, low: object, high: object) -> Column:
    return col(x).isNotNull() & col(x).between(low, high)


def is_in(x: Arg, values: str | Sequence) -> Column:
    """values: a list, or a text of values parted by commas or blanks."""
    listed = [v for v in re.split(r"[,\s]+", values) if v] if isinstance(values, str) else list(values)
    return col(x).isNotNull() & col(x).isin(listed)


def in_cidr(x: Arg, block: str) -> Column:
    return F.coalesce(ip_in_cidr(x, F.lit(block)), F.lit(False))


def tokens(x: Arg, analyser: str = "standard") -> Column:
    """The terms of a text field, in lower case, as an array."""
    split_at = ANALYSERS[analyser]
    if split_at is None:
        return F.array(text(x))
    found = F.filter(F.split(F.lower(text(x)), split_at), lambda t: t != "")
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS)) if analyser == "stop" else found


def has_term(x: Arg, term: str, analyser: str = "standard") -> Column:
    """Whether a text field holds the term (`*` and `?` allowed)."""
    if "*" in term or "?" in term:
        return F.exists(tokens(x, analyser), lambda t: t.rlike(wildcard_pattern(term.lower())))
    split_at, plain = ANALYSERS[analyser], F.lower(text(x))
    if split_at is None:
        return F.coalesce(text(x) == term.lower(), F.lit(False))
    term = term.lower()
    if not term or (analyser == "stop" and term in STOP_WORDS):
        return F.lit(False)
    # the text isn't split: the term stands between separators or ends, and holds none itself
    letter = "[" + split_at[2:-1] if split_at.startswith("[^") else r"\S"
    alone = plain.rlike(rf"(?<!{letter}){re.escape(term)}(?!{letter})") & ~F.lit(term).rlike(split_at)
    return F.coalesce(F.contains(plain, F.lit(term)) & alone, F.lit(False))


def all_of(*terms: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [t for t in terms if t is not None], F.lit(True))


def any_of(*terms: Column | None) -> Column:
    live = [t for t in terms if t is not None]
    return reduce(lambda a, b: a | b, live) if live else F.lit(True)


def none_of(*terms: Column | None) -> Column:
    live = [t for t in terms if t is not None]
    return ~any_of(*live) if live else F.lit(True)


def in_dictionary(df: DataFrame, column: str, words: DataFrame, word: str = "word", negate: bool = False) -> DataFrame:
    """The rows whose value is a word of a dictionary table. Spark broadcasts the table if it is small."""
    listed = words.select(F.col(word).alias("_word")).distinct()
    return df.join(listed, F.col(column) == F.col("_word"), "left_anti" if negate else "left_semi")


def in_folder(df: DataFrame, column: str, tree: DataFrame, folder: str) -> DataFrame:
    """The rows whose document lies under a folder of a (node, parent) tree, however deep. A tree with a cycle is an
    error."""
    under = """WITH RECURSIVE under(node) AS (SELECT node FROM {tree} WHERE parent = :folder UNION ALL SELECT t.node FROM {tree} t JOIN under u ON t.parent = u.node) SELECT node FROM under"""
    return in_dictionary(df, column, _recursive(df, under, {"folder": folder}, tree=tree), "node")


def dictionary_words(df: DataFrame, dictionaries: DataFrame, imports: DataFrame, name: str) -> DataFrame:
    """The words of a dictionary and of all those that it imports. dictionaries: (name, word); imports: (name, imported)."""
    reached = """WITH RECURSIVE reached(name) AS (SELECT :name UNION ALL SELECT i.imported FROM {imports} i JOIN reached r ON i.name = r.name) SELECT DISTINCT name FROM reached"""
    names = _recursive(df, reached, {"name": name}, imports=imports)
    return dictionaries.join(names, "name", "left_semi").select("word").distinct()


def _recursive(df: DataFrame, sql: str, args: dict, **tables: DataFrame) -> DataFrame:
    return df.sparkSession.sql(sql, args, **tables)


def time_range(x: Arg, start: object = None, end: object = None) -> Column:
    """From start (included) to end (left out)."""
    return all_of(None if start is None else col(x) >= start, None if end is None else col(x) < end)


def quick_filter(x: Arg, typed: str) -> Column:
    """All the blank-parted parts of a typed text must occur; `!` before a part turns it round."""
    parts = typed.split()
    return all_of(*[~contains(x, p[1:]) if p.startswith("!") and len(p) > 1 else contains(x, p) for p in parts])
