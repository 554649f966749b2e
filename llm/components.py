"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two grouped aggregations over edges, written to the shared folder; only a count comes
back to the driver. Star centres gather their neighbours' minimum by aggregation, never as a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(u, component) for every node that an edge (u, v) names; component is the smallest node reachable.

    Self-loops and repeated edges do no harm; an empty table gives an empty result.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # Large star: each node hands its larger neighbours to its smallest one (itself included).
        both = _both_ways(edges)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node hands itself and its smaller neighbours to the smallest of these.
        down = large.where("u > v")
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        )
        after = stored(small, "edges")
        # The rounds end when every node points at a root: no edge's lower end has an edge of its own.
        lower = after.select(F.col("v").alias("u")).distinct()
        done = after.join(lower, "u", "left_semi").isEmpty() and after.groupBy("u").count().where("count > 1").isEmpty()
        edges = after
        if done:
            break
    return edges.select("u", F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()
    )
