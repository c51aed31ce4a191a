"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, repeated up to most_repeats times. A packet (PACKET words
of a document, or a whole one) has a virtual finish time: its source's cumulative words up to and including it, divided
by the source's target. All packets are range-partitioned and sorted by finish time, and a running total over that
order cuts the mix at the total budget, the sum of the targets in whole words.

cut="word": packets that may be in service at the cut are queued once more word by word, so each source stops within a
word of its target. cut="document": documents are packets, and the one at the cut is taken if half of it fits.

Null and blank texts have size 0 and are drawn 0 times; an empty table gives an empty result. A null source is a
source of its own, last in order. Rows that share a doc_id are separate; rows equal in source, doc_id and text are
interchangeable. Null doc_ids come first among equals. All other columns of the input pass through mix(), whatever
their names; draw, virtual_finish and taken_words are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running_total, shuffled
from .scratch import materialize, quoted

WORD = r"[^\x20\x09-\x0D]+"
MOST_REPEATS = 3
PACKET = 1024
FEW_SOURCES = 10_000  # rows of a few numbers that may be broadcast


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Sorts by code point (binary order of UTF-8), null last; never null."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("k"), source.cast("string")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most_repeats: int = MOST_REPEATS) -> DataFrame:
    """(source_key, size) rows -> (source_key, source_size, target): the total of all sizes shared by weight, no
    source above most_repeats times its size, the excess shared again by weight among the others."""
    # one row a source: ranking them needs them in one place, a few bytes each
    by_source = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source_key") == "n", "source_key")) - 1
    weight = reduce(lambda so_far, x: so_far.when(F.pmod(rank, F.lit(len(weights))) == x[0], float(x[1])), enumerate(weights), F)
    table = materialize(by_source.withColumn("weight", weight), "sources")
    cap = F.col("source_size") * float(most_repeats)
    budget = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("weight") * level >= cap
        capped, open_weight = table.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        higher = (budget - (capped or 0.0)) / open_weight if open_weight else level
        if higher <= level:
            break
        level = higher
    return table.select("source_key", "source_size", F.least(F.col("weight") * level, cap).alias("target"))


def _packets(placed: DataFrame, most_repeats: int, packet: int | None) -> DataFrame:
    """(source_key, start, words, target, finish): what each source serves in turn. start: its words before."""
    step = F.lit(packet).cast("long") if packet else F.col("size")
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step)).alias("at")
    draws = placed.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(most_repeats - 1))).alias("d"))
    start = F.col("before") + F.col("d") * F.col("source_size") + F.col("at")
    return (
        draws.select("*", begin)
        .select("source_key", start.alias("start"), F.least(step, F.col("size") - F.col("at")).alias("words"), "target")
        .withColumn("finish", (F.col("start") + F.col("words")).cast("double") / F.col("target"))
    )


def _queued(packets: DataFrame) -> DataFrame:
    """packets with `part`, their place among the range partitions by finish time."""
    return packets.repartitionByRange("finish", "source_key", "start").sortWithinPartitions("finish", "source_key", "start").withColumn("part", F.spark_partition_id())


def _in_order(packets: DataFrame, name: str) -> DataFrame:
    """packets with `upto`: the words of all packets up to and including each, by finish time."""
    queue = materialize(_queued(packets), name)
    sums = queue.groupBy("part").agg(F.sum("words").alias("own"))  # a row for each range partition
    sums = sums.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("earlier"))
    here = Window.partitionBy("part").orderBy("finish", "source_key", "start").rowsBetween(Window.unboundedPreceding, 0)
    return queue.withColumn("here", F.sum("words").over(here)).join(sums, "part").withColumn("upto", F.col("earlier") + F.col("here")).drop("part", "here", "earlier")


def _served(placed: DataFrame, targets: DataFrame, most_repeats: int, cut: str) -> DataFrame:
    """(source_key, served): the words that each source has been served when the queue has spent the budget."""
    budget, sources = targets.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0)), F.count("*")).first()
    if cut != "word":
        queue = _in_order(_packets(placed, most_repeats, None), "queue")
        whole = queue.where(F.col("upto") - F.col("words") / 2 <= budget)
        return whole.groupBy("source_key").agg(F.sum("words").alias("served"))
    queue = materialize(_in_order(_packets(placed, most_repeats, PACKET), "packets"), "queue")
    # when a packet finishes, each source may have one more in service
    surely = F.col("upto") + sources * PACKET <= budget
    done = queue.where(surely).groupBy("source_key").agg(F.sum("words").alias("served"))
    spent, end = queue.agg(F.sum(F.when(surely, F.col("words"))), F.min(F.when(F.col("upto") >= budget, F.col("finish")))).first()
    open_ = queue.where(~surely)
    if end is not None:
        open_ = open_.where(F.col("start") / F.col("target") < end)
    each = open_.select("source_key", F.explode(F.sequence("start", F.col("start") + F.col("words") - 1)).alias("start"), "target")
    each = each.select("source_key", "start", F.lit(1).cast("long").alias("words"), "target", ((F.col("start") + 1).cast("double") / F.col("target")).alias("finish"))
    last = _in_order(each, "words").where(F.col("upto") <= budget - (spent or 0)).groupBy("source_key").agg(F.count("*").alias("served"))
    return done.unionByName(last).groupBy("source_key").agg(F.sum("served").alias("served"))


def schedule(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most_repeats: int = MOST_REPEATS, cut: str = "word", seed: int = 0
) -> DataFrame:
    """One row a document: doc_id, source_key, text_hash, size, source_size, target, before (source tokens that precede
    it) and draws, an array of (draw, virtual_finish, taken_words) for the draws that the budget reaches."""
    text = F.col("text").cast("string")
    sized = materialize(
        docs.select("doc_id", _source_key(F.col("source")).alias("source_key"), F.xxhash64("text").alias("text_hash"), word_count(text).alias("size")), "sizes"
    )
    targets = source_targets(sized, weights, most_repeats)
    ordered = sized.withColumn("order", shuffled("doc_id", "text_hash", seed=seed))
    placed = running_total(ordered, ["source_key"], "order", ["doc_id", "text_hash"], "size", sized.count(), "before")
    few = targets.count() <= FEW_SOURCES
    placed = materialize(placed.join(F.broadcast(targets) if few else targets, "source_key").drop("order"), "placed")
    served = materialize(_served(placed, targets, most_repeats, cut), "served")
    placed = placed.join(F.broadcast(served) if few else served, "source_key", "left")
    start = lambda d: F.col("before") + (d - 1) * F.col("source_size")
    draws = F.transform(
        F.sequence(F.lit(1), F.lit(most_repeats)),
        lambda d: F.struct(
            d.cast("int").alias("draw"),
            F.try_divide((start(d) + F.col("size")).cast("double"), F.col("target")).alias("virtual_finish"),
            # a source serves its queue in order
            F.greatest(F.lit(0), F.least(F.col("size"), F.coalesce("served", F.lit(0)) - start(d))).cast("long").alias("taken_words"),
        ),
    )
    return placed.withColumn("draws", F.filter(draws, lambda x: x["taken_words"] > 0)).drop("served")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most_repeats: int = MOST_REPEATS, cut: str = "document", seed: int = 0) -> DataFrame:
    """The mixed documents in the order of their virtual finish times, repeats as further rows, with all columns of
    docs and draw, virtual_finish and taken_words. The rows are range-partitioned and sorted by finish time."""
    docs = docs.drop("draw", "virtual_finish", "taken_words")
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id")
    hash_ = F.coalesce("text_hash", F.lit(0)).alias("hash")
    plan = materialize(schedule(docs, weights, most_repeats, cut, seed).select(id_, F.col("source_key").alias("source"), hash_, "draws", "before"), "plan")
    # the row is one struct, so that its names meet no others
    own = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), id_, _source_key(F.col("source")).alias("source"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("hash"))
    key = ["id", "source", "hash"]
    if plan.groupBy(*key).count().where("count > 1").limit(1).count():
        # rows equal in id, source and text are told apart by a number, so that each gets its own draws
        numbered = lambda df, by: df.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(by)))
        own, plan, key = numbered(own, F.xxhash64("row")), numbered(plan, "before"), [*key, "n"]
    drawn = own.join(plan.where(F.size("draws") > 0), key).select("row", "id", F.explode("draws").alias("x"))
    in_order = drawn.repartitionByRange("x.virtual_finish", "id").sortWithinPartitions("x.virtual_finish", "id")
    return in_order.select("row.*", "x.*")
