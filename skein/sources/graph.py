"""The graph's tables: schemas, validation, and the bridge from the driver's star schema."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.plans.lineage import cut

#: Trust tiers from high to low; an edge's tier is the first of its flags, `matched` without any.
TIERS = ["confirmed", "proven", "xlang", "typed", "stdlib", "declared", "inferred", "matched"]
NODE_KINDS, EDGE_KINDS = ["module", "function", "var"], ["ref", "import", "use", "reg"]


@dataclass
class Graph:
    """nodes (id, name, kind, file, line, entry), edges (src, dst, kind, n, tier, rw) and calls (fn, callee, file, line, target, rule)."""

    nodes: DataFrame
    edges: DataFrame
    calls: DataFrame

    def refs(self) -> DataFrame:
        """Reference edges without self edges, which no slice counts."""
        return self.edges.where("kind = 'ref' and src <> dst")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tier_rank(tier="tier"):
    rank = F.lit(len(TIERS))
    for k, name in enumerate(TIERS):
        rank = F.when(F.col(tier) == name, k + 1).otherwise(rank)
    return rank


def from_star(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and orders are functions, parts and suppliers variables, nations and regions modules; each order line is a call."""
    t = lambda name: table(spark, sf_dir, name)
    nation = t("nation")
    key = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    null = F.lit(None).cast("string")
    nodes = [
        t("region").select(key("r", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("module").alias("kind"), F.col("r_name").alias("file"), F.lit(0).cast("long").alias("line"), null.alias("entry")),
        nation.select(key("n", "n_nationkey"), "n_name", F.lit("module"), "n_name", F.lit(0).cast("long"), null),
        t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(key("c", "c_custkey"), "c_name", F.lit("function"), "n_name", "c_custkey", "c_mktsegment"),
        t("orders").select(key("o", "o_orderkey"), key("order.", "o_orderkey"), F.lit("function"), F.year("o_orderdate").cast("string"), "o_orderkey", null),
        t("part").select(key("p", "p_partkey"), "p_name", F.lit("var"), "p_brand", "p_partkey", null),
        t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(key("s", "s_suppkey"), "s_name", F.lit("var"), "n_name", "s_suppkey", null),
    ]
    lines = t("lineitem")
    rw = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    tier = F.when(F.bool_and(F.col("l_returnflag") == "N"), "proven").when(F.bool_or(F.col("l_returnflag") == "R"), "inferred").otherwise("matched")
    none = F.lit(None).cast("int")
    # Hardly two lines are of one edge, so they are dealt out first: counted before, a task would hold a table of all edges of its part of the input.
    # A number of partitions is named, as Spark would join small ones to 64 compressed MB, which are a gigabyte or two of such tables.
    dealt = lambda *by: lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by)
    edges = [
        nation.select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"), F.lit("import").alias("kind"), F.lit(1).cast("long").alias("n"), F.lit("matched").alias("tier"), none.alias("rw")),
        t("orders").select(key("c", "o_custkey"), key("o", "o_orderkey"), F.lit("ref"), F.lit(1).cast("long"), F.lit("matched"), none),
        dealt("l_orderkey", "l_suppkey").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"), tier.alias("tier")).select(key("o", "l_orderkey"), key("s", "l_suppkey"), F.lit("ref"), "n", "tier", none),
        dealt("l_orderkey", "l_partkey").groupBy("l_orderkey", "l_partkey", rw.alias("rw")).agg(F.count("*").alias("n")).select(key("o", "l_orderkey"), key("p", "l_partkey"), F.lit("use"), "n", F.lit("matched"), "rw"),
    ]
    resolved = F.col("l_linestatus") == "F"
    rule = F.when(resolved, null).when(F.col("l_returnflag") == "A", "ambiguous").when(F.col("l_returnflag") == "R", "blocked")
    calls = lines.select(key("o", "l_orderkey").alias("fn"), key("s", "l_suppkey").alias("callee"), F.year("l_shipdate").cast("string").alias("file"), F.col("l_linenumber").cast("long").alias("line"), F.when(resolved, key("s", "l_suppkey")).alias("target"), rule.alias("rule"))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].union(union(frames[1:]))
    return Graph(union(nodes), union(edges), calls)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) of from_star's edges but self edges, each once: told apart by their numbers, as edges of two sources are never equal."""
    out = []
    for name, p, src, q, dst in (("nation", "n", "n_nationkey", "r", "n_regionkey"), ("orders", "c", "o_custkey", "o", "o_orderkey"), ("lineitem", "o", "l_orderkey", "s", "l_suppkey"), ("lineitem", "o", "l_orderkey", "p", "l_partkey")):
        rows = table(spark, sf_dir, name).select(src, dst).where(F.col(src).isNotNull() & F.col(dst).isNotNull()).repartition(src, dst).distinct()
        out.append(rows.select(F.concat(F.lit(p), F.col(src).cast("string")).alias("src"), F.concat(F.lit(q), F.col(dst).cast("string")).alias("dst")))
    return reduce(DataFrame.union, out)


def trade(spark: SparkSession, sf_dir: str, top: int = 2) -> DataFrame:
    """(src, dst, n): each customer nation's `top` supplier nations by lines, ties by key; a small graph with cycles, made once for all rounds of a loop."""
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    sold = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_nationkey", "l_suppkey").agg(F.count("*").alias("n"))
    lines = sold.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = lines.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.col("n").desc(), "dst"))
    return cut(n.withColumn("_rank", rank).where(F.col("_rank") <= top).drop("_rank"))


def invalid(graph: Graph) -> DataFrame:
    """(problem, n): rows that break the schema: missing ids, unknown kinds, edges without an end."""
    ids = graph.nodes.select("id")
    checks = {
        "node-without-id": graph.nodes.where("id is null or name is null or file is null"),
        "node-kind": graph.nodes.where(~F.col("kind").isin(NODE_KINDS)),
        "edge-kind": graph.edges.where(~F.col("kind").isin(EDGE_KINDS)),
        "edge-source": graph.edges.join(ids, F.col("src") == F.col("id"), "anti"),
        "edge-target": graph.edges.join(ids, F.col("dst") == F.col("id"), "anti"),
    }
    out = None
    for name, df in checks.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = row if out is None else out.union(row)
    return out
