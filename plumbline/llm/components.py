"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import drop, written


def large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to its smallest; a written table."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = written(least, "least")  # apart from the join, so that AQE splits the neighbours of a hub
    out = written(both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
    drop(least)
    return out


def small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them; edges point from the larger to the smaller node. A written table."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
    drop(least)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges(a, b)``: the smallest id that it reaches. Each round is a written table, the last of which is to be dropped with the result."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, state = written(now, "edges"), None
    while True:
        large = large_star(now)
        drop(now)
        now = small_star(large)
        drop(large)
        # a star forest maps onto itself: same edges, same count and same sums of two hashes
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 2**31), F.sum(F.hash("v", "u").cast("long"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
    out.written_to = now.written_to
    return out
