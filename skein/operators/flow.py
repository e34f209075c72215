"""Data-flow analyses over edge tables: facts that spread along edges until nothing new comes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.reach import ROUNDS, travel, unique
from skein.plans.lineage import cut, stage


def live(edges: DataFrame, uses: DataFrame, defs: DataFrame) -> DataFrame:
    """(node, var) live at a node's entry: used there, or live after it and not defined in it. uses and defs are (node, var)."""
    defs = defs.select("node", "var")
    moved, loose = travel(uses.select("node", "var"), _back(edges), enter=lambda facts: facts.join(defs, ["node", "var"], "anti"))
    return moved.select("node", "var").union(unique(loose.select("node", "var")))


def _back(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reaching(edges: DataFrame, defs: DataFrame) -> DataFrame:
    """(node, var, def): definitions that reach a node's entry; defs (node, var) end other definitions of their variable."""
    defs = defs.select("node", "var")
    moved, loose = travel(defs.select("node", "var", F.col("node").alias("def")), edges, leave=lambda facts: facts.join(defs, ["node", "var"], "anti").select(*facts.columns), counted=False)
    return moved.select("node", "var", "def").union(unique(loose.select("node", "var", "def")))


def effects(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(fn, kind, key, tier): own effects and those of callees, of each key the smallest tier (1 unguarded, 2 guarded, 3 set once)."""
    moved, loose = travel(own.select(F.col("fn").alias("node"), "kind", "key", "tier"), _back(edges))
    every = moved.union(loose).select(F.col("node").alias("fn"), "kind", "key", "tier")
    return every.repartition("fn", "kind", "key").groupBy("fn", "kind", "key").agg(F.min("tier").alias("tier"))


def purity(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(fn, label): writes, io or pure, with ~ where a call that nobody resolved hedges it."""
    has = lambda kind: F.max(F.col("kind") == kind)
    per = nodes.join(found, "fn", "left").groupBy("fn").agg(has("write").alias("w"), has("io").alias("i"), has("hedge").alias("h"))
    label = F.when(F.col("w"), "writes").when(F.col("i"), "io").otherwise("pure")
    return per.select("fn", F.concat(label, F.when(F.col("h"), "~").otherwise("")).alias("label"))


def tainted(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitisers: DataFrame) -> DataFrame:
    """(source, sink) that input reaches over one hop or more without passing a sanitiser. The others are tables of (node)."""
    open_ = edges.join(sanitisers.select(F.col("node").alias("dst")), "dst", "anti").select("src", "dst")
    moved, loose = travel(sources.select("node", F.col("node").alias("source")), open_, counted=False)
    found = (x.join(sinks.select("node"), "node", "semi").select("source", F.col("node").alias("sink")) for x in (moved, loose))
    return next(found).union(unique(next(found)))


def loop_depth(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(fn, depth): the larger of a function's own nesting (fn, own) and loops around a call (src, dst, loops) plus the callee's depth.

    Calls must not form a loop: on one, depths would grow for ever, so it raises after `rounds`; condense components first.
    """
    depth = cut(nodes.select("fn", F.col("own").alias("depth")))
    calls = edges.select(F.col("src").alias("_up"), F.col("dst").alias("fn"), "loops")
    for _ in range(rounds):
        via = depth.join(calls, "fn").groupBy(F.col("_up").alias("fn")).agg(F.max(F.col("depth") + F.col("loops")).alias("via"))
        new = cut(depth.join(via, "fn", "left").select("fn", F.greatest("depth", "via").alias("depth"), (F.col("via") > F.col("depth")).alias("moved")))
        depth = new.drop("moved")
        if new.where("moved").isEmpty():
            return depth
    raise RuntimeError(f"no end after {rounds} rounds")


def dominators(edges: DataFrame, roots: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(root, node, idom, depth): of each node that a root reaches, the nearest node that all paths from the root pass.

    Nodes that no edge leaves, mostly nearly all, lie on no path to others, so chains of dominators are sought for the other nodes alone.
    What dominates a node without edges is what the chains of all that lead to it start with: chains are paths in a tree, and what the first
    and the last of them in order share, all between share. So only those two are kept of any number.
    """
    edges = edges.where("src <> dst").select("src", "dst")
    more = edges.select(F.col("src").alias("dst")).distinct().withColumn("inner", F.lit(True))
    ends = stage(edges.join(more, "dst", "left").select("src", "dst", "inner"))
    chain = _chains(ends.where("inner").select("src", "dst"), roots, rounds)
    met = chain.join(ends.where("inner is null"), F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), "chain").repartition("root", "node")
    per = met.groupBy("root", "node").agg(F.min("chain").alias("a"), F.max("chain").alias("b"))
    parts = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    shared = F.when(parts == 0, F.size("a")).otherwise(parts - 1).cast("long")
    outer = per.select("root", "node", "a", shared.alias("depth")).select("root", "node", F.element_at("a", F.col("depth").cast("int")).alias("idom"), "depth")
    return chain.where("size(chain) > 1").select("root", "node", F.element_at("chain", -2).alias("idom"), (F.size("chain") - 1).cast("long").alias("depth")).union(outer)


def _chains(edges: DataFrame, roots: DataFrame, rounds: int) -> DataFrame:
    """(root, node, chain): from the root to the node, all that each path passes.

    A node's chain starts as a shortest path to it, on which all its dominators stand in order. An edge then strikes
    from its end's chain what its source's chain lacks; chains only shrink, and where no edge strikes any more they
    are the dominators. A struck list is no longer than its chain, so nothing is gathered.
    """
    front = chain = stage(roots.select("root", F.col("root").alias("node"), F.array("root").alias("chain")).distinct())
    for done in range(1, rounds + 1):
        met = front.join(edges, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg(F.min("chain").alias("chain"))
        front = stage(met.join(chain, ["root", "node"], "anti").select("root", "node", F.concat("chain", F.array("node")).alias("chain")))
        if front.isEmpty():
            break
        chain = chain.union(front)
        if done % 8 == 0:
            chain = stage(chain)
    for _ in range(rounds):
        above = chain.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.col("chain").alias("_above"))
        lost = chain.where("size(chain) > 2").join(above, ["root", "node"]).select("root", "node", F.explode(F.array_except("chain", F.concat("_above", F.array("node")))).alias("_gone"))
        struck = stage(lost.groupBy("root", "node").agg(F.collect_set("_gone").alias("_struck")))
        if struck.isEmpty():
            return chain
        kept = F.when(F.col("_struck").isNull(), F.col("chain")).otherwise(F.array_except("chain", "_struck"))
        chain = stage(chain.join(struck, ["root", "node"], "left").select("root", "node", kept.alias("chain")))
    raise RuntimeError(f"no end after {rounds} rounds")


def shapes(tree: DataFrame) -> DataFrame:
    """(root, n, depth, children, shape) of dominator trees: trivial to 2 nodes, bushy where half hang from the root, spine from depth 4, else shallow."""
    per = tree.groupBy("root").agg((F.count("*") + 1).alias("n"), F.max("depth").alias("depth"), F.count(F.when(F.col("depth") == 1, 1)).alias("children"))
    shape = F.when(F.col("n") <= 2, "trivial").when(2 * F.col("children") >= F.col("n") - 1, "bushy").when(F.col("depth") >= 4, "spine").otherwise("shallow")
    return per.withColumn("shape", shape)
