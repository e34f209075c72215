"""Connected components of links by contraction: every round joins each node to its smallest neighbour and relabels what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.shared import drop, staged


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links (a, b): label is the smallest node reachable.

    A round takes p(u) = the smallest of u and its neighbours, follows p twice, then keeps only the distinct
    links between different labels. No group is gathered: each round is a partial minimum by node and
    two equi-joins, whose hot side Spark can split. Links and maps are written to the shared folder, so
    a lost executor repeats one round at most. Self links give their node a label; nulls are left out.
    """
    edges = staged(links.where("a is not null and b is not null").select("a", "b").distinct(), "links")
    labels = staged(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")), "labels")
    first, edges = edges, edges.where("a <> b")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("p"))
        near = staged(near, "parents")
        up = near.select(F.col("u").alias("p"), F.col("p").alias("q"))
        parent = staged(near.join(up, "p", "left").select("u", F.coalesce("q", "p").alias("p")), "grandparents")
        a, b = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        left = staged(edges.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        after = staged(labels.join(parent.toDF("label", "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        for x in (first, labels, near, parent):
            drop(x)
        first, edges, labels = left, left, after
    drop(first)
    return labels
