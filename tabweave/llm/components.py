"""Connected components by DataFrame operations: distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.session import cut_lineage


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component`` for every end of an edge; the component is its
    smallest node.

    Alternating star operations: every node hands its larger neighbours to its
    smallest one, then its smaller neighbours, until only stars are left, in a
    number of rounds that grows as the square of the logarithm at most.  Minima
    combine before the shuffle, and a node with very many neighbours is the key
    of a join only, which adaptive execution splits.  Edges with a null end and
    loops link nothing; repeated edges count once; no edges, no nodes.
    """
    ends = edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).dropna()
    current = cut_lineage(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                          .where("u <> v").distinct())
    before = None
    while True:
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))).distinct()
        current = cut_lineage(small)
        state = current.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 24))).first()
        if state == before or not state[0]:
            break
        before = state
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select("v", "v").distinct())
