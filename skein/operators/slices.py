"""Slices, lookups and aggregations over the graph's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.graph import TIERS, Graph, tier_rank


def tier_name(rank):
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), rank.cast("int"))


def neighbours(refs: DataFrame, end: str, other: str) -> DataFrame:
    """Of each node at `end`: how many others refer to it (or it refers to), at how many sites, and the weakest tier."""
    return refs.groupBy(F.col(end).alias("node")).agg(F.countDistinct(other).alias("n_nodes"), F.sum("n").alias("n_sites"), tier_name(F.max(tier_rank())).alias("weakest"))


def find(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose name is the text, ends with it after . or :, or holds it; lower-cased."""
    name = F.lower("name")
    low = text.lower()
    how = F.when(name == low, "exact").when(name.endswith("." + low) | name.endswith(":" + low), "tail").when(name.contains(low), "substring")
    return nodes.select("id", "name", "kind", "file", how.alias("match")).where("match is not null")


def disposition():
    """resolved if there is a target, else refused by a rule, else dynamic."""
    return F.when(F.col("target").isNotNull(), "resolved").when(F.col("rule").isNotNull(), "refused").otherwise("dynamic")


def census_calls(calls: DataFrame) -> DataFrame:
    return calls.groupBy(disposition().alias("disposition"), F.coalesce("rule", F.lit("none")).alias("rule")).agg(F.count("*").alias("n_calls"), F.countDistinct("callee").alias("n_callees"))


def ladder(graph: Graph) -> DataFrame:
    """Rungs of calls: a resolved call's is its edge's tier (matched shows as linked), else dynamic, refused or frontier."""
    edge = graph.edges.where("kind = 'ref'").select(F.col("src").alias("fn"), F.col("dst").alias("target"), "tier")
    rung = F.when(F.col("target").isNotNull(), F.when(F.col("tier") == "matched", "linked").otherwise(F.coalesce("tier", F.lit("linked")))).when(F.col("rule").isNotNull(), "refused").otherwise("frontier")
    return graph.calls.join(edge, ["fn", "target"], "left").groupBy(rung.alias("rung")).agg(F.count("*").alias("n_calls"))


def externals(calls: DataFrame) -> DataFrame:
    """Unresolved callees by why: ambiguous is several inside, blocked another scope, the rest external."""
    why = F.when(F.col("rule") == "ambiguous", "internal_multi").when(F.col("rule") == "blocked", "cross_scope").otherwise("external")
    return calls.where("target is null").groupBy("callee", why.alias("bucket")).agg(F.count("*").alias("n_calls"), F.countDistinct("file").alias("n_files"))


def heat(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Role of each node by callers and callees; 4 make a hub or coordinator."""
    fanin = refs.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("fanin"))
    fanout = refs.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("fanout"))
    d = nodes.select("id", F.col("entry").isNotNull().alias("exported")).join(fanin, "id", "left").join(fanout, "id", "left").fillna(0, ["fanin", "fanout"])
    i, o = F.col("fanin"), F.col("fanout")
    role = F.when((i == 0) & (o == 0), "isolated").when(i == 0, F.when(F.col("exported"), "api").otherwise("unused?")).when((i >= 4) & (i >= 2 * o), "hub").when((o >= 4) & (o >= 2 * i), "coordinator").when(o == 0, "leaf").otherwise("")
    return d.select("id", "fanin", "fanout", role.alias("role"))


def atlas(uses: DataFrame) -> DataFrame:
    """Label of each variable by its use edges: rw 1 reads, 2 writes, 3 does both; a missing one leaves it unclassified."""
    per = uses.groupBy(F.col("dst").alias("var")).agg(F.count(F.when(F.col("rw").isin(1, 3), 1)).alias("n_reads"), F.count(F.when(F.col("rw").isin(2, 3), 1)).alias("n_writes"), F.count(F.when(F.col("rw").isNull(), 1)).alias("_unknown"))
    label = F.when(F.col("_unknown") > 0, "unclassified").when(F.col("n_writes") == 0, "const").when(F.col("n_reads") == 0, "dead").when(F.col("n_writes") == 1, "single-writer").otherwise("multi-writer")
    return per.select("var", "n_reads", "n_writes", label.alias("label"))


def layering(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """(a, b, forward, backward, violation) of unordered pairs of layers from the dominant side; a minority of a quarter or less violates."""
    lay = edges.join(layers.toDF("src", "la"), "src").join(layers.toDF("dst", "lb"), "dst").where("la <> lb").groupBy("la", "lb").agg(F.count("*").alias("n"))
    low = lay.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.coalesce(F.sum(F.when(F.col("la") < F.col("lb"), F.col("n"))), F.lit(0)).alias("ab"), F.coalesce(F.sum(F.when(F.col("la") > F.col("lb"), F.col("n"))), F.lit(0)).alias("ba"))
    turn = F.col("ba") > F.col("ab")
    f, b = F.greatest("ab", "ba"), F.least("ab", "ba")
    return low.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("upper"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("lower"), f.alias("forward"), b.alias("backward"), ((b > 0) & (4 * b <= f)).alias("violation"))


def percentiles(df: DataFrame, by: str, value: str, ps=(50, 90, 99)) -> DataFrame:
    """Nearest-rank percentiles in each group."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *[F.expr(f"percentile_disc({p / 100}) within group (order by {value})").alias(f"p{p}") for p in ps])


def unreferenced(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Functions that nothing refers to and that are no entry."""
    return nodes.where("kind = 'function' and entry is null").join(refs.select(F.col("dst").alias("id")), "id", "anti").select("id", "name", "file")
