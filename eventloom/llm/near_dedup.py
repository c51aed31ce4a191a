"""Near-duplicate documents: bottom-k sketches of one hash function, inverted lists, exact confirmation.

Every document keeps the k smallest hashes of its shingle set. Two sets with a similarity of 0.8 share at least
LEAST_SHARED of 48 retained values (a binomial tail of 1e-8; sets of up to 0.8 * k shingles are retained whole, so
theirs is exact). With retained values in one global order, rarest first, such a pair meets in the inverted list of
one of each document's first k - LEAST_SHARED + 1 values; passages that many documents share come last in that order
and are seldom reached. Documents of the same words are one class (by SHA-256 of the words) before lists are made, so
that copies cost nothing. Links are confirmed on the full sets, by words that are equal in every byte.

Within a list all members are compared with the smallest one only, then with the most central one. Where that leaves
a list in one component, it is done. Members of different components are compared if a link is still possible: the
shingles that each has alone among all documents of such lists can't be shared, and both must differ from the shingles
common to their cluster in the same places. So groups of near copies don't make all their pairs.

A value that many documents retain is spread over several join keys, HOT_ROWS rows each, in every join on it.

Rows with a null doc_id are returned with a null component and kept. Null and blank texts have an empty set and link
to nothing. Repeated rows and rows that share a doc_id are one document: each row is returned. Other columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sieve
from .components import connected_components
from .scratch import bounded_batches, materialize
from .textblocks import blocks, exact_ids, mix64, shingle_set, word_hashes, words

SKETCH_SIZE = 48
LEAST_SHARED = 20
HOT_ROWS = 1024
SIGNATURE = "doc_id long, n_shingles long, fp1 long, fp2 long, sketch array<long>"
COUNTS = "a long, b long, shared long, either long"


def sketches(docs: DataFrame, shingle: int, k: int = SKETCH_SIZE) -> DataFrame:
    """doc_id, size of the shingle set, 128 bits of the SHA-256 of the words and the k smallest hashes of the set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for block in blocks(batch.column("text")):
                w = words(block)
                hashes = word_hashes(block, w, lower=True)
                n, digests, parts = [], [], []
                for i, (lo, hi) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                    s = shingle_set(hashes[lo:hi], shingle)
                    n.append(len(s))
                    text = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes()
                    # the bytes that part words are those that bytes.split() knows
                    digests.append(hashlib.sha256(b" ".join(text.lower().split())).digest()[:16])
                    parts.append(s[:k].view(np.int64))
                digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(block.first, block.last - block.first),
                        pa.array(n, pa.int64()),
                        pa.array(digest[:, 0].copy()),
                        pa.array(digest[:, 1].copy()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts))),
                    ],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, SIGNATURE)


def _salts() -> Column:
    """How many join keys a value of `df` documents is spread over."""
    return F.ceil(F.col("df") / HOT_ROWS).cast("int")


def _spread(rows: DataFrame) -> DataFrame:
    """rows (with node and df) with the `salt` that each has."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), _salts()).cast("int"))


def _copied(rows: DataFrame) -> DataFrame:
    """rows (with df, one or few for each value) once for each salt."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts() - 1))).drop("df")


def _prefix_entries(reps: DataFrame, k: int, least: int) -> DataFrame:
    """(value, df, node, n): each class under the rarest of its retained values that other classes retain too; df:
    how many classes retain the value."""
    values = reps.select("node", "n", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    exact_up_to = math.floor(0.8 * k)
    needed = F.when(F.col("n") <= exact_up_to, F.ceil(F.col("n") * 0.8 - 1e-9)).otherwise(F.lit(least))
    return (
        values.join(shared, "value")
        .groupBy("node", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found"))  # at most k values
        .withColumn("alone", F.least("n", F.lit(k)) - F.size("found"))
        .withColumn("reach", F.least("n", F.lit(k)) - needed + 1 - F.col("alone"))
        .where("reach > 0")
        .select("node", "n", F.explode(F.slice("found", 1, F.col("reach").cast("int"))).alias("x"))
        .select(F.col("x.value").alias("value"), F.col("x.df").alias("df"), "node", "n")
    )


def _estimated(pairs: DataFrame, reps: DataFrame, k: int, least: int) -> DataFrame:
    """Pairs whose union sketch still allows a similarity of 0.8."""
    left = reps.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    right = reps.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    hits = F.size(F.array_intersect(F.array_intersect(union, F.col("sa")), F.col("sb")))
    enough = F.when(F.size(union) < k, hits * 100 >= F.size(union) * 80).otherwise(hits >= least)
    return pairs.join(left, "a").join(right, "b").where(enough).select("a", "b").distinct()


def _counted(pairs: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Exact sizes of the intersection and the union of the shingle sets of each pair."""
    pairs = materialize(pairs, "pairs")
    ends = sieve.build(pairs, ["a", "b"])
    texts = sieve.keep_possible(docs.select(F.col("doc_id").cast("long").alias("node"), "text"), "node", ends)
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, either = [], []
            n = batch.num_rows
            both = pa.concat_arrays([batch.column("ta").cast(pa.large_string()), batch.column("tb").cast(pa.large_string())])
            for block in blocks(both.take(pa.array(np.arange(2 * n).reshape(2, n).T.ravel())), together=2):
                w = words(block)
                named = mix64(exact_ids(block.data, w.starts, w.ends, lower=True).astype(np.uint64))
                sets = [shingle_set(named[lo:hi], shingle) for lo, hi in zip(w.first[:-1], w.first[1:], strict=True)]
                for x, y in zip(sets[::2], sets[1::2], strict=True):
                    union = len(np.union1d(x, y))
                    shared.append(len(x) + len(y) - union)
                    either.append(union)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(either, pa.int64())],
                names=["a", "b", "shared", "either"],
            )

    found = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(count, COUNTS)
    nearest = F.max(F.struct((F.col("shared") / F.col("either")).alias("j"), "shared", "either")).alias("x")
    return found.groupBy("a", "b").agg(nearest).select("a", "b", "x.shared", "x.either")


def _full_sets(nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, value): the whole shingle sets of these documents."""
    texts = sieve.keep_possible(docs.select(F.col("doc_id").cast("long").alias("node"), "text"), "node", sieve.build(nodes, ["node"]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node").to_numpy(zero_copy_only=False)
            for block in blocks(batch.column("text")):
                w = words(block)
                hashes = word_hashes(block, w, lower=True)
                for at, (lo, hi) in enumerate(zip(w.first[:-1], w.first[1:], strict=True), block.first):
                    s = shingle_set(hashes[lo:hi], shingle)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), ids[at])), pa.array(s.view(np.int64))], names=["node", "value"])

    return texts.join(nodes, "node", "left_semi").mapInArrow(spread, "node long, value long")


def _lonely_shingles(nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, lonely): how many shingles of each of these documents none of the others has."""
    alone = _full_sets(nodes, docs, shingle).groupBy("value").agg(F.count("*").alias("df"), F.min("node").alias("node")).where("df = 1")
    return alone.groupBy("node").agg(F.count("*").alias("lonely"))


def _apart_from_common(members: DataFrame, docs: DataFrame, shingle: int, slack: float) -> tuple[DataFrame, DataFrame]:
    """Candidates among the members (node, n, part) of each cluster by what sets them apart from the cluster.

    D(x) is the symmetric difference of x's set and the shingles that half of the cluster or more have. For a link,
    |D(x) ^ D(y)| = |x ^ y| is at most slack * min(n), so D(x) and D(y) share at least half of
    |D(x)| + |D(y)| - slack * min(n). With the elements of D in one order, rarest first, both have a shared one before
    that many from their ends. Returns the pairs (a, b) found so, and (cluster, node, size) with the sizes of D; pairs
    whose bound is below 1 may share nothing and are not found here.
    """
    nodes = materialize(members.select("cluster", "node", "n", "part").distinct(), "nodes")
    sets = _full_sets(nodes.select("node").distinct(), docs, shingle).distinct()
    held = materialize(nodes.join(sets, "node"), "held")
    total = nodes.groupBy("cluster").agg(F.count("*").alias("all"))
    counted = materialize(held.groupBy("cluster", "value").agg(F.count("*").alias("df")).join(total, "cluster"), "df")
    common = counted.where(F.col("df") * 2 >= F.col("all"))
    columns = ["cluster", "node", "n", "part", "value", "df"]
    gained = held.join(counted.where((F.col("df") * 2 < F.col("all"))), ["cluster", "value"]).select(*columns)
    due = nodes.join(common.select("cluster", "value", (F.col("all") - F.col("df")).alias("df")).where("df > 0"), "cluster")
    lost = due.join(held.select("cluster", "node", "value"), ["cluster", "node", "value"], "left_anti").select(*columns)
    of_node = Window.partitionBy("cluster", "node")
    apart = gained.unionByName(lost).withColumns({"at": F.row_number().over(of_node.orderBy("df", "value")), "size": F.count("*").over(of_node)})
    apart = materialize(apart, "apart")
    sizes = nodes.select("cluster", "node").join(apart.where("at = 1").select("cluster", "node", "size"), ["cluster", "node"], "left")
    reach = F.greatest(F.lit(1), F.ceil((F.col("size") + F.greatest(F.lit(1), F.col("size") - slack * F.col("n")) - slack * F.col("n")) / 2 - 1e-9))
    entries = apart.where("df > 1").where(F.col("at") <= F.col("size") - reach + 1)
    least = F.ceil((F.col("x.size") + F.col("y.size") - slack * F.least("x.n", "y.n")) / 2 - 1e-9)
    both = (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.part") != F.col("y.part"))
    early = (least >= 1) & (F.col("x.at") <= F.col("x.size") - least + 1) & (F.col("y.at") <= F.col("y.size") - least + 1)
    pairs = entries.alias("x").join(entries.alias("y"), both & early)
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), sizes.withColumn("size", F.coalesce("size", F.lit(0)))


def _of_split_lists(members: DataFrame) -> DataFrame:
    """The members of the lists with members in several components."""
    split = members.groupBy("value", "df").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("value", "df")
    return _spread(members).join(_copied(split), ["value", "salt"]).drop("salt")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = SKETCH_SIZE, least: int = LEAST_SHARED
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_class (documents of the same words) for each row of docs.

    percent: the least similarity of a link; 80 or more, as k and least are chosen for 80.
    """
    if percent < 80:
        raise ValueError("the sketch is sized for a similarity of 0.8 or more")
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = materialize(sketches(docs, shingle, k), "sketches")
    classes = (
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("fp1", "fp2", F.col("n_shingles").alias("n"))
        .agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"), F.count("*").alias("n_class"))
    )
    reps = materialize(classes, "classes")
    entries = materialize(_prefix_entries(reps, k, least), "lists")

    lists = entries.groupBy("value", "df").agg(F.min("node").alias("pivot"), F.count("*").alias("len")).where("len > 1").drop("len")
    entries = materialize(_spread(entries).join(_copied(lists), ["value", "salt"]).drop("salt"), "lists")
    star = entries.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    first = materialize(_counted(_estimated(star, reps, k, least), docs, shingle), "counted")
    linked = lambda counted: counted.where(F.col("shared") * 100 >= F.col("either") * percent).select("a", "b")
    parts = connected_components(linked(first))

    placed = (
        entries.join(parts, "node", "left")
        .select("value", "df", "node", "n", "pivot", F.coalesce("component", "node").alias("part"))
    )
    placed = materialize(placed, "placed")
    members = materialize(_of_split_lists(placed).where("node <> pivot").drop("pivot"), "open")
    lonely = _lonely_shingles(members.select("node").distinct(), docs, shingle)
    # a lonely shingle is in no intersection: what is left bounds the similarity to any other member
    members = members.join(lonely, "node", "left").withColumn("rest", F.col("n") - F.coalesce("lonely", F.lit(0))).drop("lonely")
    members = materialize(members.where(F.col("rest") * 100 >= F.col("n") * percent), "open")
    most = F.least("x.rest", "y.rest")
    possible = (F.col("x.part") != F.col("y.part")) & (most * 100 >= (F.col("x.n") + F.col("y.n") - most) * percent)

    # a second star around the member with the fewest lonely shingles, the most central one of a group
    centre = members.groupBy("value", "df").agg(F.min(F.struct(1 - F.col("rest") / F.col("n"), "node", "part", "n", "rest")).alias("c")).select("value", "df", "c.*")
    star = _spread(members).alias("x").join(_copied(centre).alias("y"), ["value", "salt"]).where(possible).select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct()
    second = materialize(_counted(_estimated(star, reps, k, least), docs, shingle), "counted")
    edges = linked(first).unionByName(linked(second))
    if linked(second).limit(1).count():
        parts = connected_components(edges)
        members = members.drop("part").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        members = materialize(_of_split_lists(members), "open")

    # what is still apart is compared if it differs from its cluster in the same places, or hardly at all
    slack = (100 - percent) / percent
    cluster = _copied(centre.select("value", "df", F.col("node").alias("cluster")))
    members = materialize(_spread(members).join(cluster, ["value", "salt"]).drop("salt"), "open")
    other, sizes = _apart_from_common(members, docs, shingle, slack)
    lists_of = members.groupBy("node").agg(F.collect_set("value").alias("in_lists"))  # at most k values
    members = materialize(members.join(lists_of, "node").join(sizes, ["cluster", "node"]).where(F.col("size") <= slack * F.col("n")), "open")
    meets = F.array_min(F.array_intersect("x.in_lists", "y.in_lists")) == F.col("x.value")
    same_list = (F.col("x.value") == F.col("y.value")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.node") < F.col("y.node"))
    hardly = F.col("x.size") + F.col("y.size") <= slack * F.least("x.n", "y.n") + 1e-9
    close = _spread(members).alias("x").join(_copied(members).alias("y"), same_list & possible & hardly & meets).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    other = other.unionByName(close).distinct()
    third = materialize(_counted(_estimated(other, reps, k, least), docs, shingle), "counted")
    components = connected_components(edges.unionByName(linked(third))) if linked(third).limit(1).count() else parts

    named = reps.join(components, "node", "left").select(
        "fp1", "fp2", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"), "n_class"
    )
    return (
        signed.drop("sketch")
        .join(named, ["fp1", "fp2", "n_shingles"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
            F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
            F.coalesce("n_class", F.lit(1)).alias("n_class"),
        )
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that have a near duplicate of a smaller doc_id; all columns stay."""
    gone = near_duplicates(docs, shingle, percent).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
