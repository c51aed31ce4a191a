"""Line dedup by a log-template tree of fixed depth.

A line's words pass a tree: first the number of words, then the leading DEPTH words; words with a digit are variable
and count as one wildcard. Lines that are equal but for such words are one masked line, and one that stands in
least_docs documents or more recurs, whatever its shape.

The other variable fields are found among the masked lines of each leaf. The leaf is split SPLITS times by similarity:
each line goes with its most frequent word that isn't in all lines of its group. In each group a word is constant at
its place if CONSTANT_SHARE or more of the group's documents have it there, least_template_docs at least; other places
become wildcards. Lines of the same constants share a template; if LEAST_CONSTANT or more of the words without a digit
are constant and least_template_docs or more documents have the template, it recurs too.

All lines of what recurs are dropped, but for the first (by doc_id, then line number) if keep_first is set.

Documents are told apart by doc_id and text: repeated rows count once and get the same result, copies under other ids
count each. Null texts have no lines and stay null; empty texts have one empty line; lines without a word are never
dropped. A null doc_id comes first. Tables may be empty. All other columns pass through, whatever their names;
`n_lines` and `n_dropped` are replaced. A masked line is told by the hash of its leaf and one of its words, 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sieve
from .scratch import materialize, quoted
from .textblocks import Block, Words, blocks, count_in, lines, mix64, word_hashes, words

DEPTH = 3
SPLITS = 2
CONSTANT_SHARE = 0.3
LEAST_CONSTANT = 0.6
LEAST_DOCS = 2
LEAST_TEMPLATE_DOCS = 3
_WILD = np.uint64(0x7777777777777777)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _parsed(block: Block) -> tuple[Words, Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, lines, masked word hashes, first word and number of words of each line, leaf and line hash."""
    w, ls = words(block), lines(block)
    masked = word_hashes(block, w)
    masked[count_in(_DIGIT[block.data], w.starts, w.ends) > 0] = _WILD
    begin = np.searchsorted(w.starts, ls.starts)
    n = np.searchsorted(w.starts, ls.ends) - begin
    leaf = mix64(n.astype(np.uint64))
    for k in range(DEPTH):
        has = n > k
        leaf[has] = mix64(leaf[has] * np.uint64(3) + masked[begin[has] + k])
    place = np.arange(len(masked)) - np.repeat(begin, n)
    terms = mix64(masked ^ mix64(place.astype(np.uint64)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return w, ls, masked, begin, n, leaf, mix64((total[begin + n] - total[begin]) + leaf)


def _line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, line_no, leaf, line) of the lines that have a word."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                _, ls, _, _, n, leaf, line = _parsed(block)
                owner = np.repeat(np.arange(len(ls.first) - 1), np.diff(ls.first))
                at = np.flatnonzero(n)
                take = pa.array(block.first + owner[at])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).take(take) for c in ("doc_id", "row_key")],
                        pa.array((at - ls.first[owner[at]]).astype(np.int32)),
                        pa.array(leaf[at].view(np.int64)),
                        pa.array(line[at].view(np.int64)),
                    ],
                    names=["doc_id", "row_key", "line_no", "leaf", "line"],
                )

    return docs.mapInArrow(parse, "doc_id long, row_key long, line_no int, leaf long, line long")


def _words_of(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Distinct (leaf, line, place, word, lead, plain) of the words behind the leading ones, of lines whose leaf may be
    in the filter. lead, plain: how many leading words, and how many of all, have no digit."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: np.ndarray = np.zeros(0, np.uint64)
        for batch in batches:
            for block in blocks(batch.column("text")):
                _, _, masked, begin, n, leaf, line = _parsed(block)
                at = np.flatnonzero(n > DEPTH)
                at = at[sieve.test(shared.value, leaf[at])]
                _, once = np.unique(line[at], return_index=True)
                at = at[once]
                at = at[~np.isin(line[at], seen)]
                seen = line[at] if len(seen) > 1 << 20 else np.concatenate([seen, line[at]])
                lead, plain = count_in(masked != _WILD, begin[at], begin[at] + DEPTH), count_in(masked != _WILD, begin[at], begin[at] + n[at])
                rest = n[at] - DEPTH
                place = DEPTH + np.arange(int(rest.sum())) - np.repeat(np.cumsum(rest) - rest, rest)
                word = masked[np.repeat(begin[at], rest) + place]
                rows = [np.repeat(x, rest) for x in (leaf[at].view(np.int64), line[at].view(np.int64))]
                rows += [place.astype(np.int32), word.view(np.int64), np.repeat(lead, rest).astype(np.int32), np.repeat(plain, rest).astype(np.int32)]
                keep = word != _WILD
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in rows], names=["leaf", "line", "place", "word", "lead", "plain"])

    return docs.select("text").mapInArrow(parse, "leaf long, line long, place int, word long, lead int, plain int").distinct()


def _counted(found: DataFrame, *by: str) -> DataFrame:
    """(by, docs): in how many documents."""
    return found.groupBy(*by, "doc_id", "row_key").agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count("*").alias("docs"))


def _line_templates(keyed: DataFrame, line_docs: DataFrame, least_docs: int) -> DataFrame:
    """(leaf, line, template) of the lines that are mostly constant words of their group."""
    # of leaves that least_docs documents may share, with several lines
    leaves = line_docs.groupBy("leaf").agg(F.sum("docs").alias("docs"), F.count("*").alias("lines")).where((F.col("docs") >= least_docs) & (F.col("lines") > 1))
    leaves = materialize(leaves, "leaves")
    each = _words_of(keyed, sieve.build(leaves, ["leaf"])).join(leaves.select("leaf"), "leaf", "left_semi").join(line_docs, ["leaf", "line"])
    each = materialize(each.withColumn("group", F.col("leaf")), "each")
    for split in range(SPLITS + 1):
        of_group = each.groupBy("group", "line").agg(F.first("docs").alias("docs")).groupBy("group").agg(F.sum("docs").alias("all"), F.count("*").alias("lines"))
        shares = each.groupBy("group", "place", "word").agg(F.sum("docs").alias("here"), F.count("*").alias("here_lines")).where(F.col("here") >= least_docs)
        # words that too few documents have are constant in no part of the group either
        each = materialize(each.join(shares, ["group", "place", "word"]).join(of_group, "group"), "shared")
        if split < SPLITS:
            several = F.when(F.col("here_lines") < F.col("lines"), F.struct("here", (-F.col("place")).alias("place"), "word"))
            able = F.count("*") + F.first("lead") >= F.first("plain") * LEAST_CONSTANT
            anchors = each.groupBy("group", "line").agg(F.max(several).alias("anchor"), able.alias("able")).where("able")
            anchors = anchors.select("group", "line", F.xxhash64("group", "anchor.word", "anchor.place").alias("into"))
            each = each.join(anchors, ["group", "line"]).select("leaf", "line", "place", "word", "lead", "plain", "docs", F.col("into").alias("group"))
            each = materialize(each, "each")
    constant = F.col("here") >= F.col("all") * CONSTANT_SHARE
    shaped = each.where(constant).groupBy("group", "leaf", "line", "lead", "plain").agg(F.bit_xor(F.xxhash64("place", "word")).alias("shape"), F.count("*").alias("n"))
    shaped = shaped.where(F.col("n") + F.col("lead") >= F.col("plain") * LEAST_CONSTANT)
    return shaped.select("leaf", "line", F.xxhash64("group", "shape").alias("template"))


def recurring_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_template_docs: int = LEAST_TEMPLATE_DOCS, keep_first: bool = True) -> DataFrame:
    """(doc_id, row_key, line_no) of the lines to drop; row_key is xxhash64 of doc_id and text."""
    keyed = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_key"), F.col("text").cast("string"))
    found = materialize(_line_rows(keyed), "lines")
    line_docs = materialize(_counted(found, "leaf", "line"), "line_docs")
    shapes = materialize(_line_templates(keyed, line_docs, least_template_docs), "shapes")
    of_shape = materialize(found.join(shapes, ["leaf", "line"]).select("template", "doc_id", "row_key"), "shaped")
    templates = _counted(of_shape, "template").where(F.col("docs") >= least_template_docs)
    recurring = line_docs.where(F.col("docs") >= least_docs).select("leaf", "line").join(shapes.join(templates, "template").select("leaf", "line", "template"), ["leaf", "line"], "full")
    recurring = materialize(recurring.withColumn("template", F.coalesce("template", F.xxhash64("leaf", "line"))), "recurring")
    # the left side is a table as it lies, so that adaptive execution can split a line that very many documents have
    gone = materialize(found.join(recurring, ["leaf", "line"]).select("doc_id", "row_key", "line_no", "template"), "gone")
    if not keep_first:
        return gone.drop("template")
    first = gone.groupBy("template").agg(F.min(F.struct("doc_id", "line_no", "row_key")).alias("x")).select("x.*")
    same = gone["doc_id"].eqNullSafe(first["doc_id"]) & (gone["row_key"] == first["row_key"]) & (gone["line_no"] == first["line_no"])
    return gone.drop("template").join(first, same, "left_anti")


def drop_recurring_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_template_docs: int = LEAST_TEMPLATE_DOCS, keep_first: bool = True) -> DataFrame:
    """docs with the text less its recurring lines, and n_lines and n_dropped."""
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    gone = recurring_lines(docs, least_docs, least_template_docs, keep_first).groupBy("doc_id", "row_key").agg(F.collect_set("line_no").alias("gone"))  # of one document
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key"), "gone")
    # the row is one struct, so that its names meet no others
    rows = docs.select(F.struct(*map(quoted, kept)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text"))
    joined = rows.join(gone, (F.col("key") == F.col("gone_key")) & F.col("id").eqNullSafe(F.col("gone_id")), "left")
    parts = F.split("text", "\n", -1)
    rest = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("gone", i)), "\n")
    return joined.select(
        *[F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest).alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in kept],
        F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"),
        F.greatest(F.lit(0), F.coalesce(F.size("gone"), F.lit(0))).alias("n_dropped"),
    )
