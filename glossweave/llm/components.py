"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import cut


def _least_neighbour(rows: DataFrame) -> DataFrame:
    """Rows (u, v) with m, the least of u and all its neighbours v.

    The minimum is pre-aggregated before its shuffle; a hub's rows meet its one minimum in a
    sort-merge join, which adaptive execution splits when the hub is large.
    """
    least = rows.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return rows.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rows = _least_neighbour(both).where("v > u")
    return rows.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Expects u > v in every row."""
    rows = _least_neighbour(edges)
    return (
        rows.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(rows.select("u", F.col("m").alias("v")))
        .distinct()
    )


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Columns node and component (the smallest node reachable) of every node that has an edge.

    Nodes without an edge to another node, and edges with a null end, give no row. Each round
    is two joins over the edges that are left and is written to the checkpoint folder; the
    number of rounds grows with the logarithm of the longest path. An empty table of edges
    gives an empty result.
    """
    now = cut(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") > F.col("v")))
        .distinct()
    )
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark or seen[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v"), F.col("v"))
            ).distinct()
        mark = seen
        now = cut(_small_star(_large_star(now)))
