"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one shuffle of the edges by node and a window over the node's neighbours. The large star also sees whether
its input was stars already, smallest node in the middle; then its labels are the answer, so no round is run only to
find that nothing moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize


def _by_node(edges: DataFrame) -> DataFrame:
    """Each edge once, those of a node together: what follows by node needs no further shuffle."""
    return edges.repartition("a").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """(a, b, m, first, apart): every edge from both ends, with the smallest m of a and its neighbours. apart: a has
    two smaller neighbours, or smaller and larger ones, so it isn't in a star; first: one row of each node."""
    there, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.select(F.explode(F.array(there, back)).alias("x")).select("x.*")
    of_node = Window.partitionBy("a")
    low, high = F.min("b").over(of_node), F.max("b").over(of_node)
    return _by_node(both).select(
        "a", "b", F.least(low, "a").alias("m"), (F.col("b") == low).alias("first"), ((low < F.col("a")) & (low < high)).alias("apart")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are joined to the smallest of them. edges: a > b."""
    m = F.min("b").over(Window.partitionBy("a"))
    return _by_node(edges).select("a", "b", m.alias("m")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, component): component is the smallest node that can be reached. Nodes without an
    edge are not listed; self-links, repeated edges and edges with a null end count for nothing."""
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        labelled = materialize(_large_star(links), "links")
        if not labelled.where("apart").limit(1).count():
            return labelled.where("first").select(F.col("a").alias("node"), F.col("m").alias("component"))
        links = _small_star(labelled.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))
