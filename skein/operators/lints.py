"""Lint rules as declared queries: what a rule quantifies over, what it must see to hold, and how rules run over a graph or a cut of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.graph import Graph

GRAINS = ("fn", "file", "corpus")


@dataclass(frozen=True)
class Rule:
    """find gives (subject, n). A witness stands by itself in any cut; a promise only where the cut contains all that it is closed over."""

    name: str
    quantifier: str
    closed_over: str
    find: Callable[[Graph], DataFrame]

    def holds_in(self, grain: str) -> bool:
        return self.quantifier == "witness" or GRAINS.index(grain) >= GRAINS.index(self.closed_over)


def _functions(g: Graph) -> DataFrame:
    return g.nodes.where("kind = 'function'")


def dead_functions(g: Graph) -> DataFrame:
    return _functions(g).where("entry is null").join(g.refs().select(F.col("dst").alias("id")), "id", "anti").select(F.col("id").alias("subject"), F.lit(0).cast("long").alias("n"))


def dead_state(g: Graph) -> DataFrame:
    per = g.edges.where("kind = 'use'").groupBy(F.col("dst").alias("subject")).agg(F.count(F.when(F.col("rw").isin(2, 3), 1)).alias("n"), F.count(F.when(F.col("rw").isin(1, 3), 1)).alias("r"), F.count(F.when(F.col("rw").isNull(), 1)).alias("u"))
    return per.where("n > 0 and r = 0 and u = 0").select("subject", "n")


def access_points(g: Graph, callers: int = 15, callees: int = 2) -> DataFrame:
    i = g.refs().groupBy(F.col("dst").alias("subject")).agg(F.countDistinct("src").alias("n")).where(F.col("n") >= callers)
    o = g.refs().groupBy(F.col("src").alias("subject")).agg(F.countDistinct("dst").alias("o"))
    return i.join(o, "subject", "left").where(F.coalesce("o", F.lit(0)) <= callees).select("subject", "n")


def silent_drops(g: Graph) -> DataFrame:
    return g.calls.where("target is null and rule is null").groupBy(F.col("fn").alias("subject")).agg(F.count("*").alias("n"))


def dynamic_dispatch(g: Graph) -> DataFrame:
    return g.calls.where("target is null and rule is null").groupBy(F.col("file").alias("subject")).agg(F.count("*").alias("n"))


def redefined(g: Graph) -> DataFrame:
    return _functions(g).groupBy("file", "name").agg(F.count("*").alias("n")).where("n > 1").select(F.concat_ws("::", "file", "name").alias("subject"), "n")


def swallowed_types(g: Graph) -> DataFrame:
    return g.edges.where("kind = 'ref' and tier = 'inferred'").groupBy(F.col("dst").alias("subject")).agg(F.sum("n").alias("n"))


def use_without_import(g: Graph) -> DataFrame:
    """Files that call into another file (of the target) which no import edge of theirs names."""
    at = g.nodes.select(F.col("id").alias("target"), F.col("file").alias("owner"))
    used = g.calls.where("target is not null").join(at, "target").where("owner <> file").groupBy("file", "owner").agg(F.count("*").alias("n"))
    names = g.nodes.where("kind = 'module'").select("id", "file")
    imports = g.edges.where("kind = 'import'").join(names.toDF("src", "file"), "src").join(names.toDF("dst", "owner"), "dst").select("file", "owner").distinct()
    return used.join(imports, ["file", "owner"], "anti").select(F.concat_ws(" -> ", "file", "owner").alias("subject"), "n")


def unused_imports(g: Graph) -> DataFrame:
    """Imports of a module that nothing else in the importing module's file refers to."""
    names = g.nodes.where("kind = 'module'").select("id", "file")
    imports = g.edges.where("kind = 'import'").join(names.toDF("src", "file"), "src").join(names.toDF("dst", "owner"), "dst")
    at = g.nodes.select("id", "file")
    across = g.refs().join(at.toDF("src", "file"), "src").join(at.toDF("dst", "owner"), "dst").select("file", "owner").distinct()
    return imports.join(across, ["file", "owner"], "anti").groupBy(F.col("src").alias("subject")).agg(F.count("*").alias("n"))


RULES = [
    Rule("dead-function", "promise", "corpus", dead_functions), Rule("dead-state", "promise", "corpus", dead_state), Rule("access-point", "witness", "corpus", access_points),
    Rule("silent-drop", "witness", "fn", silent_drops), Rule("dynamic-dispatch", "witness", "file", dynamic_dispatch), Rule("redefined-function", "witness", "file", redefined),
    Rule("swallowed-type", "witness", "corpus", swallowed_types), Rule("use-without-require", "promise", "corpus", use_without_import), Rule("redundant-require", "promise", "file", unused_imports),
]


def run(graph: Graph, grain: str = "corpus", rules: list[Rule] = RULES) -> DataFrame:
    """(rule, quantifier, subject, n) of all rules that hold in a cut of that grain."""
    found = [r.find(graph).select(F.lit(r.name).alias("rule"), F.lit(r.quantifier).alias("quantifier"), "subject", F.col("n").cast("long").alias("n")) for r in rules if r.holds_in(grain)]
    return reduce(DataFrame.union, found)


def resource_leaks(steps: DataFrame, order: list[str]) -> DataFrame:
    """(fn, var, n) of steps (fn, var, op): acquisitions that the next acquisition overwrites, with no release between."""
    after = F.lead("op").over(Window.partitionBy("fn", "var").orderBy(*order))
    held = steps.where("op in ('acquire', 'release')").withColumn("_next", after)
    return held.where("op = 'acquire' and _next = 'acquire'").groupBy("fn", "var").agg(F.count("*").alias("n"))


def member_leaks(steps: DataFrame) -> DataFrame:
    """(var, n): what is acquired somewhere and released nowhere."""
    return steps.where("op = 'acquire'").join(steps.where("op = 'release'").select("var"), "var", "anti").groupBy("var").agg(F.count("*").alias("n"))


def listener_audit(events: DataFrame) -> DataFrame:
    """(key, finding) of events (key, op): subscribed but not registered, registered but not subscribed, subscribed but not unsubscribed.

    Each is held back where the other side has a dynamic (null) key, which might be the one.
    """
    per = events.where("key is not null").groupBy("key").agg(*[F.max((F.col("op") == op).cast("int")).alias(op) for op in ("register", "subscribe", "unsubscribe")])
    dark = events.where("key is null").agg(*[F.coalesce(F.max((F.col("op") == op).cast("int")), F.lit(0)).alias(f"no_{op}") for op in ("register", "subscribe", "unsubscribe")])
    j = per.join(F.broadcast(dark))  # one row
    finding = lambda test, name: F.when(F.expr(test), name)
    all_ = F.array(finding("subscribe = 1 and register = 0 and no_register = 0", "unregistered"), finding("register = 1 and subscribe = 0 and no_subscribe = 0", "unsubscribed"), finding("subscribe = 1 and unsubscribe = 0 and no_unsubscribe = 0", "kept"))
    return j.select("key", F.explode(F.filter(all_, lambda x: x.isNotNull())).alias("finding"))


def tag_coverage(built: DataFrame, tested: DataFrame) -> DataFrame:
    """(family, tag): tags (family, tag) that are built but not tested, in families of which some tag is tested."""
    some = tested.select("family").distinct()
    return built.select("family", "tag").distinct().join(some, "family", "semi").join(tested.select("family", "tag").distinct(), ["family", "tag"], "anti")


def annotation_mismatch(functions: DataFrame) -> DataFrame:
    """(id, missing) of functions (id, documented, params): documented parameters that aren't in the signature."""
    odd = F.array_sort(F.array_except("documented", "params"))
    return functions.select("id", F.array_join(odd, ",").alias("missing")).where("missing <> ''")


def route_audit(used: DataFrame, registered: DataFrame) -> DataFrame:
    """(name, n_used, n_registered, finding) of route names: unregistered, duplicate or unused; sound ones are left out."""
    j = used.groupBy("name").agg(F.count("*").alias("n_used")).join(registered.groupBy("name").agg(F.count("*").alias("n_registered")), "name", "full").fillna(0, ["n_used", "n_registered"])
    return j.withColumn("finding", F.when(F.col("n_registered") == 0, "unregistered").when(F.col("n_registered") > 1, "duplicate").when(F.col("n_used") == 0, "unused")).where("finding is not null")


def raw_sites(calls: DataFrame, least: int = 2) -> DataFrame:
    """(table, n_sites, n_files): tables that are named at several raw sites (table, file)."""
    return calls.groupBy("table").agg(F.count("*").alias("n_sites"), F.countDistinct("file").alias("n_files")).where(F.col("n_sites") >= least)
