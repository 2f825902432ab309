"""Connected components of large edge tables, without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .work import store


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge: the smallest node it reaches.

    Each round, all components hook onto their smallest neighbour at once, follow that
    pointer a few times, and the edges between different components go on to the next
    round. At least half of the unfinished components vanish in a round; the driver only
    learns whether edges are left.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    labels = store(
        both.select("u").union(both.select("v")).groupBy(F.col("u").alias("node")).agg(F.max(F.lit(0)).alias("x")).select("node", F.col("node").alias("label"))
    )
    open_edges = store(both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    while not open_edges.isEmpty():
        there = open_edges.select(F.col("u").alias("l"), F.col("v").alias("m")).union(open_edges.select("v", "u"))
        hook = there.groupBy("l").agg(F.min("m").alias("m")).select("l", F.least("l", "m").alias("m"))
        for _ in range(2):
            hook = store(hook)
            further = hook.select(F.col("l").alias("m"), F.col("m").alias("further"))
            hook = hook.join(further, "m").select("l", F.col("further").alias("m"))
        hook = store(hook)
        labels = store(
            labels.join(hook.withColumnRenamed("l", "label"), "label", "left").select("node", F.coalesce("m", "label").alias("label"))
        )
        end = {e: hook.select(F.col("l").alias(e), F.col("m").alias(f"new_{e}")) for e in ("u", "v")}
        moved = open_edges.join(end["u"], "u").join(end["v"], "v").filter("new_u <> new_v")
        open_edges = store(moved.select(F.least("new_u", "new_v").alias("u"), F.greatest("new_u", "new_v").alias("v")).distinct())
    return labels
