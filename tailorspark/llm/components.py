"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailorspark.llm.store import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node with an edge; component = smallest node reachable.

    ``edges``: two columns of node ids, undirected; nulls and loops are ignored.
    Alternates "large-star" and "small-star" steps: each replaces a node's
    neighbours by links to the smallest one, so a path of n nodes needs
    O(log n) rounds and no node's whole neighbourhood is ever gathered (the
    smallest neighbour is an aggregate).  The edge table of every round is
    stored in the shared folder; only a count and a checksum reach the driver.
    """
    a, b = edges.columns[:2]
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
               .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    before = None
    while True:
        # large star: every larger neighbour of a node links to its smallest neighbour (itself included)
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's smaller neighbours and the node itself link to the smallest of them
        small = big.groupBy("u").agg(F.min("v").alias("m"))
        e = stored(big.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
                   .union(small).distinct(), "edges")
        mark = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())
        if mark == before:
            break
        before = mark
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select("v", "v")).distinct()
