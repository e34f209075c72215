"""Closure, cones, territories, components, levels and cycles over edge tables; loops cut their lineage every third round."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.lineage import cut, stage

ROUNDS = 1000


def unique(rows: DataFrame) -> DataFrame:
    """The distinct rows, dealt out before they are compared: where hardly two of a task are equal, comparing them there first only takes memory."""
    return rows.repartition(*rows.columns).distinct()


def travel(seeds: DataFrame, edges: DataFrame, leave: Callable[[DataFrame], DataFrame] = lambda x: x, enter: Callable[[DataFrame], DataFrame] = lambda x: x, counted: bool = True, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """All facts (node, ...) that follow from seeds by moving along edges (src, dst), with `depth`, in two parts without a common fact: distinct ones, and some that may repeat.

    `leave` takes the facts that go on from where they are, but not seeds, and `enter` those that arrive. Seeds are facts themselves if they are `counted`.
    Most facts are at nodes that no edge leaves. They go nowhere, so they aren't compared and kept in each round but come from one join at the end,
    and facts from which only such nodes can be reached take no part in rounds. Raises after `rounds`.
    """
    columns = seeds.columns
    # deep: of a node that edges leave, whether one of them leads to a node that edges leave; else null.
    more = edges.select("src").distinct().select(F.col("src").alias("dst"), F.lit(True).alias("more"))
    deep = edges.join(more, "dst", "left").groupBy("src").agg(F.max(F.coalesce("more", F.lit(False))).alias("deep")).withColumnRenamed("src", "dst")
    ends = stage(edges.join(deep, "dst", "left").select("src", "dst", "deep"))
    at = [F.col("dst" if c == "node" else c).alias(c) for c in columns]
    hop = lambda front, kind: enter(front.drop("deep").join(ends.where(kind), F.col("node") == F.col("src")).select(*at, "deep", (F.col("depth") + 1).alias("depth")))
    start = front = stage(seeds.select(*columns, F.lit(True).alias("deep"), F.lit(0).alias("depth")))
    parts = []
    step = 0
    while not (front if step else ends).where("deep is not null" if step == 0 else "deep").isEmpty():
        step += 1
        if step > rounds:
            raise RuntimeError(f"no end after {rounds} rounds")
        new = hop((leave(front) if step > 1 else front).where("deep"), "deep is not null")
        front = new.repartition(*columns).groupBy(*columns).agg(F.first("deep").alias("deep"), F.first("depth").alias("depth"))
        if known := ([start] if counted else []) + parts:
            front = front.join(reduce(DataFrame.union, [x.select(*columns) for x in known]), columns, "anti")
        front = stage(front)
        parts.append(front)
        if len(parts) == 16:
            parts = [stage(reduce(DataFrame.union, parts))]
    moved = reduce(DataFrame.union, parts) if parts else start.where("false")
    loose = hop(start.union(leave(moved)) if parts else start, "deep is null")
    return moved.drop("deep"), (start.union(loose) if counted else loose).drop("deep")


def closure(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(root, node, depth): each node that a path of edges (src, dst) leads to from a seed (root), and its least length. Raises after `rounds`."""
    moved, loose = travel(seeds.select(F.col("root").alias("node"), "root"), edges, rounds=rounds)
    pairs = loose.repartition("root", "node").groupBy("root", "node").agg(F.min("depth").alias("depth"))
    return moved.select("root", "node", "depth").union(pairs)


def cone(edges: DataFrame, seeds: DataFrame, inward: bool = False) -> DataFrame:
    """(root, node, depth) without the anchor itself, even on a cycle."""
    if inward:
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(edges, seeds).where("node <> root")


def territory(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(node, n_entries, class): territory of one entry, core of all, else commons. An entry reaches itself."""
    reached = closure(edges, entries)
    k = entries.agg(F.countDistinct("root").alias("k"))
    per = reached.groupBy("node").agg(F.count("*").alias("n_entries"))
    kind = F.when(F.col("n_entries") == 1, "territory").when(F.col("n_entries") == F.col("k"), "core").otherwise("commons")
    return per.join(F.broadcast(k)).select("node", "n_entries", kind.alias("class"))  # one row


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those that surely are on no cycle, as nothing leads to where they start or nothing leaves where they end; again while that takes a tenth of them."""
    left = stage(unique(edges.where("src <> dst").select("src", "dst")))
    size = left.count()
    while size:
        to, of = left.select(F.col("src").alias("dst")).distinct(), left.select(F.col("dst").alias("src")).distinct()
        left = stage(left.join(to, "dst", "semi").join(of, "src", "semi").select("src", "dst"))
        before, size = size, left.count()
        if size > 0.9 * before:
            break
    return left


def components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components, named by their smallest node, by colouring.

    Nodes off all cycles are mostly trimmed before. Each round, the smallest node that reaches a node is its colour; within a colour, what reaches
    the colour's node is its component and leaves. Both directions run as propagation joins, so nothing is gathered.
    """
    every = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    left = trimmed(edges)
    nodes = cut(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct())
    done = None
    while not nodes.isEmpty():
        colour = nodes.withColumn("colour", F.col("node"))
        while True:
            low = left.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("low"))
            new = cut(colour.join(low, "node", "left").select("node", F.least("colour", F.coalesce("low", "colour")).alias("colour"), (F.col("low") < F.col("colour")).alias("moved")))
            if new.where("moved").isEmpty():
                colour = new.drop("moved")
                break
            colour = new.drop("moved")
        c = colour
        inside = left.join(c.toDF("src", "a"), "src").join(c.toDF("dst", "b"), "dst").where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = closure(inside, c.where("node = colour").select(F.col("node").alias("root"))).select("node", F.col("root").alias("component"))
        found = cut(found)
        done = found if done is None else done.union(found)
        nodes = cut(nodes.join(found, "node", "anti"))
        left = cut(left.join(nodes.toDF("src"), "src", "semi").join(nodes.toDF("dst"), "dst", "semi"))
    if done is None:
        return every.withColumn("component", F.col("node"))
    return every.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def levels(edges: DataFrame) -> DataFrame:
    """(component, level): 0 if it reaches nothing outside itself, else one more than the highest of its successors.

    Components without successors are peeled off round by round, and their edges with them; a level is the number of rounds that a component outlasts.
    """
    comp = stage(components(edges))
    between = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    moved = comp.where("node <> component")
    if not moved.isEmpty():
        for end in ("a", "b"):
            between = between.join(moved.select(F.col("node").alias(end), "component"), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        between = between.where("a <> b")
    left = stage(unique(between.select("a", "b")))
    lasted, step = [], 0
    while not left.isEmpty():
        step += 1
        above = left.select(F.col("a").alias("component")).distinct()
        lasted.append(above.withColumn("level", F.lit(step)))
        left = stage(left.join(above.toDF("b"), "b", "semi").select("a", "b"))
        if len(lasted) == 16:
            lasted = [stage(reduce(DataFrame.union, lasted).groupBy("component").agg(F.max("level").alias("level")))]
    lasted.append(comp.select("component", F.lit(0).alias("level")))
    return reduce(DataFrame.union, lasted).groupBy("component").agg(F.max("level").alias("level"))
