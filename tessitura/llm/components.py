"""Connected components of a distributed edge list by alternating large-star and small-star rounds.

Each round joins every node with the smallest of its neighbours; the edge list stays linear in the input and no node's
neighbours are ever gathered: minima are partial aggregates, and the join back is one that the engine can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import staged


def _small(e: DataFrame) -> DataFrame:
    """Every node's smaller neighbours and the node itself go to the smallest of them."""
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _large(e: DataFrame) -> DataFrame:
    """Every node's larger neighbours go to the smallest of its neighbours and itself."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (u, v), u <> v, to (node, label) with the smallest node of each component as its label, for all nodes that
    have an edge and aren't their own label."""
    e = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    while True:
        e = staged(_small(_large(e)), name)
        # a star forest in which no node is both a leaf and a hub is final; the sum tells a repeated state as well
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(now) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = tuple(now)
