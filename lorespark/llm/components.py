"""Connected components of an edge table by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond", 2014. Nothing but round checksums reaches the
driver, every round's edges are a stored table (deleted once the next is there), and the smallest neighbours are a table of their own so that
a node of very many edges is a skewed join that Spark splits.

Rows: an edge of a node with itself, or with a null end, is left out; repeated edges count once, in either
direction; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b), a > b: every node links its larger (or smaller) neighbours to its least one."""
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    met = edges.join(least, "a")
    moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    out = moved if large else moved.unionByName(own)
    out = materialize(out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    drop(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """id, label for each node of edges (a, b): label is the least id of its component."""
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    check = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (now.n, now.x) == check or not now.n:
            break
        check = (now.n, now.x)
        half = _star(edges, True)
        drop(edges)
        edges = _star(half, False)
        drop(half)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
