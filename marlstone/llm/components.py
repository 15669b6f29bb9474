"""Connected components of a link table by contraction with pseudo-random priorities.

Each round a node takes the smallest-priority node among itself and its neighbours as parent, and links are moved to the
parents. The nodes that still have links shrink by a constant share a round in expectation, so the rounds grow with the
logarithm of the largest component. Links live in tables of the shared folder; only their count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, release

ROUNDS = 64


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of longs: (node, root) for each node with a link, the same root for all nodes of a component."""
    links = cut(links.where("a != b").select("a", "b"), "links")
    parents: list[DataFrame] = []
    for k in range(ROUNDS):
        if links.isEmpty():
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Priorities change from round to round; xxhash64 of the node and the round orders them, the node breaks ties.
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("p"), F.col(c).alias("v"))
        nearest = both.groupBy("a").agg(F.min(rank("b")).alias("n"))
        parent = cut(nearest.select(F.col("a").alias("node"), F.least(rank("a"), F.col("n")).getField("v").alias("up")), "parents")
        parents.append(parent)
        up = parent.where("node != up")  # a table: joins shuffle it, and hot nodes can be split
        moved = links.join(up.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("up", "a").alias("a"), "b")
        moved = moved.join(up.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("up", "b").alias("b"))
        before, links = links, cut(moved.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        release(before)
    else:
        raise RuntimeError(f"links remain after {ROUNDS} rounds")
    if not parents:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    root = parents[-1].select("node", F.col("up").alias("root"))
    for parent in reversed(parents[:-1]):
        later = root.select(F.col("node").alias("up"), "root")
        root = parent.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return root
