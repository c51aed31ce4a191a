"""K-d tree sharding: documents are split at weighted medians of metadata until leaves reach the target bytes.

A node that must make k leaves is cut along its widest dimension (range relative to the whole table's, over the
dimensions that still vary) where floor(k / 2) / k of its bytes come before. Cuts are found by histograms: each pass
sums bytes by node and bin, and the driver, which gets BINS sums a node at most, narrows each node's interval to the
bin that holds the cut. All nodes of a level are cut in the same passes. Ties in the dimension are ordered by the
CRC-32 of the text, so equal texts stay together, and then by a hash of the doc_id: a group of equal texts is cut only
if it holds more than TOLERANCE of a leaf's target, else the cut moves to its nearer end.

A cut lies within half of the row or group at it, or of TOLERANCE of a target, from its place. So a leaf's bytes are
within ceil(log2(shards)) * max(largest row, TOLERANCE * target) of the target; the nearer, the smaller the rows are.

Null and empty texts count 16 bytes. Null metadata sorts before all other values. Repeated rows are never parted by a
cut. An empty table gives no rows. Columns with other names are ignored by assign() and pass through shard().
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running_total, shuffled
from .scratch import materialize, quoted

ROW_BYTES = 16
BINS = 4096
TOLERANCE = 0.02
_SPAN = (1 << 63) - 1


@dataclass
class Node:
    """A node of the tree. Rows go low if (key, tie) is below (cut, tie_cut) in dimension dim."""

    leaves: int
    first: int
    dim: int = -1
    cut: int = 0
    tie_cut: int = 0
    children: list[Node] = field(default_factory=list)


def default_dimensions() -> list[Column]:
    """Size by magnitude, and language and source by the order of their names (of their first six bytes; null first): all
    as doubles."""

    def place(name: str) -> Column:
        first = F.rpad(F.hex(F.substring(F.encode(F.col(name).cast("string"), "UTF-8"), 1, 6)), 12, "0")
        return F.when(F.col(name).isNull(), -1.0).otherwise(F.conv(first, 16, 10).cast("double"))

    return [F.log2(F.col("size").cast("double")), place("lang"), place("source")]


def describe(docs: DataFrame, dimensions: list[Column] | None = None) -> DataFrame:
    """doc_id, row_key (of doc_id and text), size, text_crc32, tie and keys (an order-preserving long for
    each dimension, then the text's CRC-32)."""
    text = F.col("text").cast("string")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")],
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        row_key(docs).alias("row_key"),
    )
    dims = dimensions or default_dimensions()
    valued = materialize(base.select("doc_id", "row_key", "size", "text_crc32", F.array(*dims).alias("dims")), "described")
    spread = valued.agg(*[F.struct(F.min(F.col("dims")[i]), F.max(F.col("dims")[i])) for i in range(len(dims))]).first()
    keys = []
    for i, (low, high) in enumerate(spread):
        width = (high - low) if low is not None and high > low else 1.0
        step = F.floor((F.col("dims")[i] - F.lit(low or 0.0)) / F.lit(width) * F.lit(float(2**30))).cast("long")
        keys.append(F.shiftleft(step, 32) + F.col("text_crc32"))
    return valued.select("doc_id", "row_key", "size", "text_crc32", shuffled("doc_id", seed=7).alias("tie"), F.array(*keys).alias("keys"))


def row_key(docs: DataFrame) -> Column:
    """Tells rows apart by all that default_dimensions() and the size read."""
    read = [c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in read])


def _node_of(leaves: list[Node], node: Node) -> Column:
    """The index in leaves of the leaf that a row falls to."""
    if not node.children:
        return F.lit(leaves.index(node))
    key = F.col("keys")[node.dim]
    low = (key < node.cut) | ((key == node.cut) & (F.col("tie") < node.tie_cut))
    return F.when(low, _node_of(leaves, node.children[0])).otherwise(_node_of(leaves, node.children[1]))


def _descended(rows: DataFrame, before: list[Node], after: list[Node]) -> DataFrame:
    """rows with `leaf`, an index in `before`, made one in `after`, where some of those leaves are cut in two."""
    of_leaf = lambda values: F.get(F.array(*[F.lit(x).cast("long") for x in values]), F.col("leaf"))
    key, cut = F.get("keys", of_leaf(max(x.dim, 0) for x in before).cast("int")), of_leaf(x.cut for x in before)
    low = (key < cut) | ((key == cut) & (F.col("tie") < of_leaf(x.tie_cut for x in before)))
    first = of_leaf(next(i for i, y in enumerate(after) if y is (x.children[0] if x.children else x)) for x in before)
    high = (of_leaf(int(bool(x.children)) for x in before) == 1) & ~low
    return rows.withColumn("leaf", (first + high.cast("long")).cast("int"))


def _leaves(node: Node) -> list[Node]:
    return [x for child in node.children for x in _leaves(child)] if node.children else [node]


def _narrow(rows: DataFrame, low: list[int], high: list[int], wanted: list[float], slack: float) -> tuple[list[int], list[int], list[float], list[float]]:
    """By histograms of `value`, each node's interval [low, high] shrinks to one value, or to a bin of so few bytes
    that its end will do. Returns the intervals, the bytes before each and the bytes inside."""
    before, inside, done = [0.0] * len(low), [float("inf")] * len(low), [False] * len(low)
    while not all(done):
        width = [max(1, -(-(h - lo + 1) // BINS)) for lo, h in zip(low, high, strict=True)]
        sums = (
            rows.select("node", "size", "value", _of_node(low, done).alias("low"), _of_node(high, done).alias("high"), _of_node(width, done).alias("width"))
            .where("value between low and high")
            .groupBy("node", F.expr("(value - low) div width").alias("bin"))
            .agg(F.sum("size").alias("bytes"))
            .toArrow()
        )
        of, bins, sizes = (sums[c].to_numpy() for c in ("node", "bin", "bytes"))
        order = np.lexsort((bins, of))
        of, bins, sizes = of[order], bins[order], sizes[order]
        for i in range(len(low)):
            if done[i]:
                continue
            mine = slice(*np.searchsorted(of, [i, i + 1]))
            until = before[i] + np.cumsum(sizes[mine], dtype=float)
            if not len(until):
                inside[i], high[i] = 0, min(high[i], low[i] + width[i] - 1)
            else:
                k = min(int(np.searchsorted(until, wanted[i])), len(until) - 1)
                b = int(bins[mine][k])
                before[i], inside[i] = float(until[k] - sizes[mine][k]), float(sizes[mine][k])
                low[i], high[i] = low[i] + b * width[i], min(high[i], low[i] + (b + 1) * width[i] - 1)
            done[i] = low[i] == high[i] or inside[i] <= slack
    return low, high, before, inside


def _of_node(values: list[int], hidden: list[bool]) -> Column:
    """The value of a row's node; null for hidden nodes."""
    return F.get(F.array(*[F.lit(None if h else v).cast("long") for v, h in zip(values, hidden, strict=True)]), F.col("node"))


def grow(described: DataFrame, shards: int) -> Node:
    """The k-d tree of so many leaves."""
    n_dims = len(described.first()["keys"])
    total = described.agg(F.sum("size")).first()[0]
    whole = described.agg(*[F.max(F.shiftright(F.col("keys")[d], 32)) for d in range(n_dims)]).first()
    root = Node(shards, 0)
    # rows know their leaf, so that no pass over a level walks the tree
    placed, leaves = described.select("size", "tie", "keys", F.lit(0).alias("leaf")), [root]
    while True:
        if root.children:
            before, leaves = leaves, _leaves(root)
            if any(x.leaves > 1 for x in leaves):
                placed = materialize(_descended(placed, before, leaves), "level")
        opened = [x for x in leaves if x.leaves > 1]
        if not opened:
            return root
        at = placed.withColumn(
            "node", F.element_at(F.array(*[F.lit(opened.index(x) if x.leaves > 1 else -1) for x in leaves]), F.col("leaf") + 1)
        )
        at = at.where("node >= 0")
        ranges = {
            r["node"]: r
            for r in at.groupBy("node")
            .agg(F.sum("size").alias("bytes"), *[F.min(F.shiftright(F.col("keys")[d], 32)).alias(f"l{d}") for d in range(n_dims)], *[F.max(F.shiftright(F.col("keys")[d], 32)).alias(f"h{d}") for d in range(n_dims)])
            .collect()
        }
        wanted, floor, ceiling = [], [], []
        for i, node in enumerate(opened):
            r = ranges.get(i)
            widths = [(r[f"h{d}"] - r[f"l{d}"]) / max(1, whole[d]) if r else 0 for d in range(n_dims)]
            node.dim = max(range(n_dims), key=lambda d: (widths[d], -d))
            floor.append(r[f"l{node.dim}"] << 32 if r else 0)
            ceiling.append((r[f"h{node.dim}"] << 32) + (1 << 32) - 1 if r else 0)
            wanted.append((r["bytes"] if r else 0) * (node.leaves // 2) / node.leaves)
        slack = max(1.0, total / shards * TOLERANCE / 20)
        rows = at.select("node", "size", "tie", F.get("keys", F.get(F.array(*[F.lit(x.dim) for x in opened]), F.col("node"))).alias("value"))
        low, high, before, inside = _narrow(rows, floor, ceiling, wanted, slack)
        split = []
        for i, node in enumerate(opened):
            if low[i] == high[i] and inside[i] > total / shards * TOLERANCE:
                split.append(i)
            nearer_end = before[i] + inside[i] / 2 < wanted[i]
            node.cut, node.tie_cut = (high[i] + 1, 0) if nearer_end else (low[i], 0)
        if split:
            whole_node = [i not in split for i in range(len(low))]
            at_cut = rows.where(F.col("value") == _of_node(low, whole_node))
            order = [split.index(i) if i in split else 0 for i in range(len(low))]
            group = at_cut.select(_of_node(order, whole_node).cast("int").alias("node"), "size", F.col("tie").alias("value"))
            lo, hi, pre, own = _narrow(group, [0] * len(split), [_SPAN] * len(split), [wanted[i] - before[i] for i in split], slack)
            for k, i in enumerate(split):
                opened[i].cut = low[i]
                opened[i].tie_cut = hi[k] + 1 if pre[k] + own[k] / 2 < wanted[i] - before[i] else lo[k]
        for node in opened:
            half = node.leaves // 2
            node.children = [Node(half, node.first), Node(node.leaves - half, node.first + half)]


def assign(docs: DataFrame, shards: int, dimensions: list[Column] | None = None) -> DataFrame:
    """doc_id, row_key, size, text_crc32, shard and slot (its place in the shard, gapless from 0) for each row."""
    described = materialize(describe(docs, dimensions), "keys")
    rows = described.count()
    columns = ["doc_id", "row_key", "size", "text_crc32", "shard", "slot"]
    if not rows:
        return described.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).select(*columns)
    root = grow(described, shards)
    leaves = _leaves(root)
    shard_of = F.element_at(F.array(*[F.lit(x.first) for x in leaves]), _node_of(leaves, root) + 1)
    placed = described.withColumns({"shard": shard_of.cast("int"), "one": F.lit(1).cast("long")}).drop("keys")
    return running_total(placed, ["shard"], "tie", ["doc_id", "row_key"], "one", rows, "slot").select(*columns)


def shard(docs: DataFrame, shards: int, dimensions: list[Column] | None = None) -> DataFrame:
    """docs with shard and slot added; all columns stay (a shard or slot of docs is replaced). Rows of one row_key fall
    to one shard and share out its slots by number."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    placed = materialize(assign(docs, shards, dimensions).select(F.col("row_key").alias("_key"), "shard", "slot"), "placed")
    numbered = lambda df, by: df.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(by)))
    # the row is one struct, so that its names meet no others
    own = numbered(docs.select(F.struct(*map(quoted, kept)).alias("row"), row_key(docs).alias("_key")), F.xxhash64("row"))
    return own.join(numbered(placed, "slot"), ["_key", "_n"]).select("row.*", "shard", "slot")


def shards_for(docs: DataFrame, target_bytes: int) -> int:
    """The least number of leaves whose mean is at most target_bytes."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    return max(1, -(-size // target_bytes))

