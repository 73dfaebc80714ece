"""Connected components by contraction: edges shrink in every round, nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, shared_dir, stash


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges`` (a, b): the least node that its links reach.

    In each round a node goes over to its least neighbour and edges are drawn anew between those; a hub's
    edges are reduced before the shuffle. Both tables are written between rounds. Without edges: no rows.
    """
    spark = edges.sparkSession
    at = shared_dir(spark)
    live = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), at)
    old = [at]
    found = None
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        parent = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("parent")).withColumnRenamed("a", "was")
        at = shared_dir(spark)
        parent = stash(parent, at)
        old.append(at)
        if found is None:
            moved = parent.select(F.col("was").alias("node"), F.col("parent").alias("component"))
        else:
            moved = found.join(parent, found["component"] == parent["was"], "left").select("node", F.coalesce("parent", "component").alias("component"))
        at = shared_dir(spark)
        moved = stash(moved, at)
        old.append(at)
        up, down = parent.select(F.col("was").alias("a"), F.col("parent").alias("pa")), parent.select(F.col("was").alias("b"), F.col("parent").alias("pb"))
        at = shared_dir(spark)
        drawn = live.join(up, "a").join(down, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        live, found = stash(drawn, at), moved
        for path in old:
            if path is not old[-1]:
                drop_stash(spark, path)
        old = [old[-1], at]
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).where("false")
    return found
