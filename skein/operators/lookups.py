"""Lookups and references: files by trailing path, durable references, provenance, chains of links, arguments and ports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.graph import TIERS

#: Rungs of calls from high to low.
RUNGS = ["confirmed", "proven", "linked", "typed", "declared", "inferred", "dynamic", "refused", "frontier"]


def tail(name: Column) -> Column:
    """The part of a name after its last . or : mark."""
    return F.regexp_extract(name, r"([^.:]*)$", 1)


def base_member(name: Column) -> tuple[Column, Column]:
    """A call's name split at the first . or : after an identifier; without one the member is null."""
    at = r"^([A-Za-z_][A-Za-z0-9_]*)[.:](.+)$"
    split = name.rlike(at)
    return F.when(split, F.regexp_extract(name, at, 1)).otherwise(name), F.when(split, F.regexp_extract(name, at, 2))


def resolve_files(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """(q, n, path, outcome): files (path) that each wanted trailing path (q) names; one is resolved, several are ambiguous, none is missing.

    Every path gives its trailing parts, so the match is an equi-join, not a comparison of all paths with all queries.
    """
    parts = F.split("path", "/")
    tails = paths.distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("q"))
    found = wanted.distinct().join(tails, "q", "left").groupBy("q").agg(F.count("path").alias("n"), F.min("path").alias("least"))
    outcome = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return found.select("q", "n", F.when(F.col("n") == 1, F.col("least")).alias("path"), outcome.alias("outcome"))


def sibling_ordinal(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with `ordinal`: the place from 1 among those of the same file, kind and name."""
    return nodes.withColumn("ordinal", F.row_number().over(Window.partitionBy("file", "kind", "name").orderBy(*order)))


def resolve_refs(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref, id, how) of durable references (ref, file, kind, name, witness, ordinal) to nodes (id, file, kind, name, witness, ordinal).

    The only node of that file, kind and name; else the only one with the witness; else the one of the ordinal; else ambiguous or missing.
    Nodes are counted by what a reference compares before they meet any, so references and nodes of one name make no pairs.
    """
    on = ["file", "kind", "name"]
    found = refs.select("ref", *on, "witness", "ordinal")
    for by, n, first in ((on, "n", "i"), ([*on, "witness"], "nw", "iw"), ([*on, "ordinal"], "no", "io")):
        found = found.join(nodes.groupBy(*by).agg(F.count("id").alias(n), F.min("id").alias(first)), by, "left")
    per = found.groupBy("ref").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "nw", "no")], *[F.min(c).alias(c) for c in ("i", "iw", "io")])
    how = F.when(F.col("n") == 1, "name").when(F.col("nw") == 1, "witness").when(F.col("no") == 1, "ordinal").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    pick = F.when(F.col("n") == 1, F.col("i")).when(F.col("nw") == 1, F.col("iw")).when(F.col("no") == 1, F.col("io"))
    return per.select("ref", pick.alias("id"), how.alias("how"))


def tier_of(flags: dict[str, Column]) -> Column:
    """The first flag that is set down the ladder; matched without any."""
    out = F.lit("matched")
    for name in reversed(TIERS[:-1]):
        if name in flags:
            out = F.when(flags[name], name).otherwise(out)
    return out


def rung(target: Column, flags: dict[str, Column], dynamic: Column, candidates: Column) -> Column:
    """The rung of a call: of a resolved one confirmed, proven, typed, declared, inferred or linked; else dynamic, refused with candidates, or frontier."""
    landed = F.lit("linked")
    for name in ("inferred", "declared", "typed", "proven", "confirmed"):
        if name in flags:
            landed = F.when(flags[name], name).otherwise(landed)
    return F.when(target.isNotNull(), landed).when(dynamic, "dynamic").when(candidates > 0, "refused").otherwise("frontier")


def shares(counts: DataFrame, n: str = "n") -> DataFrame:
    """counts with `pct`: each row's share of all in percent, rounded to a tenth. One row per rung meets in one task."""
    return counts.withColumn("pct", F.floor(F.col(n) / F.sum(n).over(Window.partitionBy()) * 1000 + 0.5) / 10)


def provenance(calls: DataFrame, by: list[str], stage: str) -> DataFrame:
    """by, n and the sorted distinct stages that landed the calls; stages are few, so each group's list is short."""
    return calls.groupBy(*by).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(stage)), ",").alias("provs"))


def chain(start: DataFrame, links: list[tuple[DataFrame, bool]]) -> DataFrame:
    """(start, step, reached, absence): start (key) taken through links (src, dst) step by step.

    Keys that a step leads nowhere stop there: `absent` if the link is declared complete, else `frontier`.
    """
    here, out = start.select(F.col("key").alias("start"), F.col("key").alias("at")).distinct(), []
    for step, (link, complete) in enumerate(links, 1):
        went = here.join(link.select(F.col("src").alias("at"), "dst").distinct(), "at", "left")
        out.append(went.where("dst is null").groupBy("start").agg(F.lit(step).alias("step"), F.count("*").alias("reached"), F.lit("absent" if complete else "frontier").alias("absence")))
        here = went.where("dst is not null").select("start", F.col("dst").alias("at")).distinct()
    out.append(here.groupBy("start").agg(F.lit(len(links)).alias("step"), F.count("*").alias("reached"), F.lit(None).cast("string").alias("absence")))
    return reduce(DataFrame.union, out)


def cascade_update(rows: DataFrame, key: str, edits: DataFrame) -> DataFrame:
    """rows with their key replaced by that of edits (old, new); keys are distinct in edits."""
    return rows.join(edits, F.col(key) == F.col("old"), "left").withColumn(key, F.coalesce("new", key)).drop("old", "new")


def unnest(rows: DataFrame, key: str, group: Column) -> DataFrame:
    """(key, pos, member): a repeating group as a child relation with its parent's key."""
    return rows.select(F.col(key).alias("key"), F.posexplode(group).alias("pos", "member"))


def prefix_of(names: DataFrame) -> DataFrame:
    """(prefix, n, total): the text up to the first _ that more than half of the names have, or no row."""
    at = F.regexp_extract("name", "^([^_]*_)", 1)
    total = names.agg(F.count("*").alias("total"))
    return names.where(at != "").groupBy(at.alias("prefix")).agg(F.count("*").alias("n")).join(F.broadcast(total)).where("2 * n > total")  # one row


def link_tables(code: DataFrame, schema: DataFrame) -> DataFrame:
    """(name, found, n, outcome): tables named in code matched with the schema's by lower-cased name, else with the schema's prefix before it.

    matched, missing (several candidates too), or unused for a table of the schema that no code names.
    """
    c = code.select(F.lower("name").alias("name")).distinct()
    s = schema.select(F.lower("name").alias("name")).distinct()
    prefix = F.coalesce(F.first("prefix"), F.lit("")).alias("prefix")
    pre = prefix_of(s).agg(prefix)
    keys = s.join(F.broadcast(pre)).select(F.col("name").alias("found"), F.explode(F.array_distinct(F.array("name", F.when((F.col("prefix") != "") & F.col("name").startswith(F.col("prefix")), F.expr("substr(name, length(prefix) + 1)")).otherwise(F.col("name"))))).alias("name"))
    both = c.join(keys, "name", "left").withColumn("exact", F.col("found") == F.col("name"))
    best = both.groupBy("name").agg(F.count("found").alias("n"), F.max("exact").alias("exact"), F.min(F.when(F.col("exact"), F.col("found"))).alias("own"), F.min("found").alias("least"))
    hit = F.when(F.col("exact"), F.col("own")).when(F.col("n") == 1, F.col("least"))
    out = best.select("name", hit.alias("found"), "n", F.when(hit.isNotNull(), "matched").otherwise("missing").alias("outcome"))
    unused = s.join(out.where("found is not null").select(F.col("found").alias("name")), "name", "anti")
    return out.union(unused.select("name", F.lit(None).cast("string"), F.lit(0).cast("long"), F.lit("unused")))


def contract(stubs: DataFrame, methods: DataFrame) -> DataFrame:
    """(path, n_stubs, n_methods, outcome) of stub literals and declared methods with one wire path: linked, undeclared or uncalled."""
    a = stubs.groupBy("path").agg(F.count("*").alias("n_stubs"))
    b = methods.groupBy("path").agg(F.count("*").alias("n_methods"))
    out = a.join(b, "path", "full").fillna(0, ["n_stubs", "n_methods"])
    return out.withColumn("outcome", F.when(F.col("n_methods") == 0, "undeclared").when(F.col("n_stubs") == 0, "uncalled").otherwise("linked"))


def overlay(edges: DataFrame, observed: DataFrame) -> DataFrame:
    """(src, dst, outcome): static edges confirmed by observation or not observed, and observed ones that were recovered."""
    e, o = edges.select("src", "dst").distinct().withColumn("s", F.lit(True)), observed.select("src", "dst").distinct().withColumn("o", F.lit(True))
    both = e.join(o, ["src", "dst"], "full")
    return both.select("src", "dst", F.when(F.col("s").isNull(), "recovered").when(F.col("o"), "confirmed").otherwise("static").alias("outcome"))


def band_resolve(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(band, name, id, how) of wanted (band, name) in index (band, name, id): the only one in the own band, else the only one elsewhere, else refused."""
    own = index.groupBy("band", "name").agg(F.count("*").alias("n_own"), F.min("id").alias("own"))
    every = index.groupBy("name").agg(F.count("*").alias("n_all"), F.min("id").alias("any"))
    j = wanted.distinct().join(own, ["band", "name"], "left").join(every, "name", "left")
    how = F.when(F.col("n_own") == 1, "band").when(F.col("n_own").isNull() & (F.col("n_all") == 1), "unique").when(F.col("n_all") > 0, "refused").otherwise("missing")
    return j.select("band", "name", F.when(how == "band", F.col("own")).when(how == "unique", F.col("any")).alias("id"), how.alias("how"))


def ports(calls: DataFrame, bands: DataFrame) -> DataFrame:
    """(band, provides, needs): names called from other bands, and names of other bands called; calls (file, target), bands (id, band)."""
    b = bands.select(F.col("id").alias("target"), F.col("band").alias("to"))
    across = calls.where("target is not null").join(b, "target").where("to <> file")
    p = across.groupBy(F.col("to").alias("band")).agg(F.countDistinct("target").alias("provides"))
    n = across.groupBy(F.col("file").alias("band")).agg(F.countDistinct("target").alias("needs"))
    return p.join(n, "band", "full").fillna(0, ["provides", "needs"])


def coverage(required: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, provided, unknown, pct): of the required names (name) how many each profile (profile, name) provides, tightest first by pct."""
    total = required.agg(F.countDistinct("name").alias("total"))
    have = profiles.distinct().join(required.distinct(), "name", "semi").groupBy("profile").agg(F.count("*").alias("provided"))
    out = profiles.select("profile").distinct().join(have, "profile", "left").fillna(0, ["provided"]).join(F.broadcast(total))  # one row
    return out.select("profile", "provided", (F.col("total") - F.col("provided")).alias("unknown"), (F.floor(F.col("provided") / F.col("total") * 1000 + 0.5) / 10).alias("pct"))


def site_verdicts(sites: DataFrame, here: DataFrame, there: DataFrame) -> DataFrame:
    """sites with `verdict`: whether the name that each calls is lost, gained, kept or in neither profile when it moves."""
    j = sites.join(here.select("name").distinct().withColumn("h", F.lit(True)), "name", "left").join(there.select("name").distinct().withColumn("t", F.lit(True)), "name", "left")
    h, t = F.coalesce("h", F.lit(False)), F.coalesce("t", F.lit(False))
    return j.withColumn("verdict", F.when(h & ~t, "lost").when(~h & t, "gained").when(h & t, "kept").otherwise("neither")).drop("h", "t")


def origins(calls: DataFrame, i: int) -> DataFrame:
    """(target, fn, file, line, kind, value): the i-th argument (from 0) at every call site; args are structs of kind and value. A missing argument is kind `absent`."""
    arg = F.try_element_at("args", F.lit(i + 1))
    return calls.where("target is not null").select("target", "fn", "file", "line", F.coalesce(arg["kind"], F.lit("absent")).alias("kind"), arg["value"].alias("value"))


def sites_union(*parts: tuple[str, DataFrame]) -> DataFrame:
    """(name, file, line, how): sites (name, file, line) of several kinds, each place once, under the first kind that has it."""
    rows = reduce(DataFrame.unionByName, [df.select("name", "file", "line", F.lit(k).alias("_k"), F.lit(kind).alias("_how")) for k, (kind, df) in enumerate(parts)])
    return rows.groupBy("name", "file", "line").agg(F.min(F.struct("_k", "_how")).getField("_how").alias("how"))
