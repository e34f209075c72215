"""Set operations: diffs of edge sets and snapshots, requirement sets, links, co-change, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edge_diff(before: DataFrame, after: DataFrame, key: list[str], signature: str) -> DataFrame:
    """Keys that were added, removed, or changed: of which the multiset of signatures differs."""
    bag = lambda df, name: df.groupBy(*key).agg(F.sort_array(F.collect_list(signature)).alias(name))
    both = bag(before, "_a").join(bag(after, "_b"), key, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(*key, change.alias("change")).where("change is not null")


def move_diff(required: DataFrame, here: DataFrame, there: DataFrame) -> DataFrame:
    """Each required name (name, n_calls): lost, gained, kept or neither by the sets of names that two places provide."""
    d = required.join(here.select("name", F.lit(1).alias("_h")).distinct(), "name", "left").join(there.select("name", F.lit(1).alias("_t")).distinct(), "name", "left")
    h, t = F.col("_h").isNotNull(), F.col("_t").isNotNull()
    return d.select("name", "n_calls", F.when(h & ~t, "lost").when(~h & t, "gained").when(h & t, "kept").otherwise("neither").alias("outcome"))


def coupling(touched: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, together, confidence): symbols that commits (commit, symbol) touch together, confidence by a's commits.

    Pairs are made within a commit only, whose size bounds them; commits with more symbols than a change by hand has are
    mass edits and are left to the caller to filter.
    """
    n = int(touched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = touched.select("commit", "symbol").repartition(n, "commit").distinct()
    solo = t.groupBy(F.col("symbol").alias("a")).agg(F.count("*").alias("solo"))
    # Hardly two pairs of a task are equal, so pairs are dealt out before they are counted, to partitions that Spark doesn't join again.
    pairs = t.alias("x").join(t.alias("y"), "commit").where("x.symbol < y.symbol").select(F.col("x.symbol").alias("a"), F.col("y.symbol").alias("b")).repartition(n, "a", "b")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    return pairs.join(solo, "a").select("a", "b", "together", (F.col("together") / F.col("solo")).alias("confidence"))


def ledger(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Per group: symbols (group, symbol) added and removed, and the operation that the change is named."""
    sides = before.select(by, "symbol", F.lit(1).alias("s")).distinct().union(after.select(by, "symbol", F.lit(2)).distinct()).groupBy(by, "symbol").agg(F.sum("s").alias("s"))
    d = sides.groupBy(by).agg(F.count(F.when(F.col("s") == 2, 1)).alias("added"), F.count(F.when(F.col("s") == 1, 1)).alias("removed"), F.count(F.when(F.col("s") == 3, 1)).alias("kept"))
    a, r = F.col("added"), F.col("removed")
    return d.withColumn("operation", F.when((a == 0) & (r == 0), "internal").when((a == 1) & (r == 1), "rename").when((a > 0) & (r == 0), "extract").when((r > 0) & (a == 0), "inline").otherwise("restructure"))


def pair_audit(acquired: DataFrame, released: DataFrame) -> DataFrame:
    """Keys (key, n) acquired but not released, and the reverse."""
    both = acquired.groupBy("key").agg(F.count("*").alias("n_acquired")).join(released.groupBy("key").agg(F.count("*").alias("n_released")), "key", "full").fillna(0)
    return both.select("key", "n_acquired", "n_released", F.when(F.col("n_released") == 0, "acquired-not-released").when(F.col("n_acquired") == 0, "released-not-acquired").otherwise("paired").alias("finding"))


def link(left: DataFrame, right: DataFrame) -> DataFrame:
    """(n_left, n_linked, n_dangling, n_ambiguous, max_fan, is_function) of keys on two sides; null keys are unreadable and don't dangle."""
    l, r = (d.where("key is not null").groupBy("key").agg(F.count("*").alias(n)) for d, n in ((left, "nl"), (right, "nr")))
    j = l.join(r, "key", "left").fillna(0, ["nr"])
    unread = left.agg(F.count(F.when(F.col("key").isNull(), 1)).alias("n_unreadable"))
    out = j.agg(F.sum("nl").alias("n_left"), F.sum(F.when(F.col("nr") > 0, F.col("nl")).otherwise(0)).alias("n_linked"), F.sum(F.when(F.col("nr") == 0, F.col("nl")).otherwise(0)).alias("n_dangling"), F.count(F.when((F.col("nl") > 1) & (F.col("nr") > 1), 1)).alias("n_ambiguous"), F.max("nr").alias("max_fan"))
    return out.withColumn("is_function", F.col("max_fan") <= 1).join(F.broadcast(unread))  # one row


def confirm(calls: DataFrame, observed: DataFrame) -> DataFrame:
    """Verdict of each (fn, callee) with a static target against observed targets."""
    seen = observed.groupBy("fn", "callee").agg(F.countDistinct("target").alias("n"))
    hit = observed.select("fn", "callee", "target").distinct().withColumn("hit", F.lit(1))
    j = calls.select("fn", "callee", "target").distinct().join(seen, ["fn", "callee"]).join(hit, ["fn", "callee", "target"], "left")
    return j.select("fn", "callee", F.when(F.col("target").isNull(), "recovered").when(F.col("hit") == 1, "confirmed").when(F.col("n") == 1, "conflict").otherwise("polymorphic").alias("verdict"))


def transitions(events: DataFrame, by: str, order: list[str], state: str) -> DataFrame:
    """(source, target, n) between consecutive states of each group."""
    before = F.lag(state).over(Window.partitionBy(by).orderBy(*order))
    return events.select(before.alias("source"), F.col(state).alias("target")).where("source is not null").groupBy("source", "target").agg(F.count("*").alias("n"))
