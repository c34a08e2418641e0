"""Connected components by alternating large-star and small-star rounds on an edge table.

Every round is a grouped minimum, combined on the map side, and a join on the
node. The minimum is grouped by the node and its hash: its exchange then can't
serve the join, so both sides of the join have an exchange of their own and
adaptive execution can split the partition of a hot node, such as the centre of
a star with a third of all edges. Lineage is cut by a reliable checkpoint each
round. The result maps each node that has an edge to the smallest node it
reaches.

Defined cases: an edge with a null end and an edge from a node to itself link
nothing. Repeated edges count once. No edges give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    """(n, m): the smallest neighbour of each node."""
    return edges.groupBy("u", F.xxhash64("u")).agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are linked to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("n", F.least("n", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Edges have u > v."""
    least = _least(edges)
    moved = edges.join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node reachable."""
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = cut(edges)
    before = _state(edges)
    while before[0]:
        edges = cut(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == before:
            break
        before = now
        release(edges.sparkSession)  # a round's exchanges go before the next one's are written
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
