"""Connected components of a graph that is kept in tables: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """One step. edges: (u, v) with u > v, each once. Nodes are hung on the least neighbour. Also the table to discard after it."""
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written first: the join then stands right on two shuffles, and AQE can split a hub's edges.
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    joined = both.join(least, "u")
    if large:  # neighbours above u move to the least around u
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and its neighbours, all below, move to the least of them
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct(), least


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes of the edges (a, b); component is the least node that can be reached.

    Edges may repeat, run either way or join a node to itself; edges with a null are dropped. Rounds go on
    until nothing changes, a number that grows with the logarithm of the nodes. Each shuffles the remaining
    edges, of which there are never more than at first, and is written to the shared folder. Minima are taken
    map side first; the joins are on node and are split by AQE where a hub is hot.
    """
    a_, b_ = F.col(a), F.col(b)
    now = stored(edges.where(a_ != b_).select(F.greatest(a_, b_).alias("u"), F.least(a_, b_).alias("v")).distinct(), "edges")
    selves = edges.where(a_ == b_).select(a_.alias("node")).distinct()
    state = None
    while True:
        wide, least = _star(now, True)
        wide = stored(wide, "large-star")
        discard(least, now)
        now, least = _star(wide, False)
        now = stored(now, "small-star")
        discard(least, wide)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = selves.join(now.select(F.col("u").alias("node")).unionByName(now.select(F.col("v").alias("node"))), "node", "left_anti")
    return found.unionByName(roots).unionByName(alone.select("node", F.col("node").alias("component")))
