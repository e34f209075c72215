"""URL filters: host and path rules, and trust and distrust propagated over the hosts' links for what no rule fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.shared import staged, table

#: Fixed rules: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
ROUNDS, DAMPING = 8, 0.85
#: Rounds are of the SQL only; the operator goes on until verdicts are settled, and raises after LIMIT rounds. TIE: masses that differ by less are equal.
LIMIT, STEP, TIE = 4000, 4, 1e-9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)href\s*=\s*["'](?:https?:)?//([^"'/?#\s]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _open(state: DataFrame, damping: float) -> bool:
    """Whether any host's verdict can still change.

    Masses only grow, and all that a kind still adds to a host is at most its last step's sum times damping / (1 - damping).
    Hosts that no round has met yet are open as long as a round meets new ones.
    """
    last = state.groupBy("kind").agg(F.sum("step").alias("step"), F.max(~F.col("old")).alias("new")).collect()
    more = {r.kind: r.step * damping / (1 - damping) for r in last}
    if any(r.new for r in last):
        return True
    trust, distrust = more.get("trust", 0.0), more.get("distrust", 0.0)
    hosts = _masses(state).withColumn("most", F.greatest("trust", "distrust"))
    line = F.col("trust") * (1 + TIE)
    settled = (F.col("distrust") > line + trust * (1 + TIE)) | (F.col("distrust") + distrust <= line) | (F.lit(max(trust, distrust)) <= F.col("most") * (TIE / 1000))
    return not hosts.where(~settled).isEmpty()


def _masses(state: DataFrame) -> DataFrame:
    mass = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0)).alias(kind)
    return state.groupBy("host").agg(mass("trust"), mass("distrust"))


def propagate(edges: DataFrame, seeds: DataFrame, limit: int = LIMIT, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank: trust along edges (src, dst, w), distrust against them.

    seeds: (host, kind, mass), kind 'trust' or 'distrust'; 1 - damping of it stays, and each round hosts pass on what the last
    one brought them, by the weights of their edges; what a host without edges would pass on ends there. Both run as one table;
    a round is an equi-join and a partial sum by host, written to the shared folder every few rounds, which end once what is
    still to come can't change whether distrust exceeds trust at any host. After `limit` rounds without that a RuntimeError is raised.
    """
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "w").union(edges.select(F.lit("distrust"), "dst", "src", "w"))
    sums = both.groupBy("kind", "host").agg(F.sum("w").alias("all"))
    both = staged(both.join(sums, ["kind", "host"]).select("kind", "host", "to", (F.col("w") / F.col("all")).alias("share")), "edges")
    kept = F.col("mass").cast("double") * (1 - damping)
    state = staged(seeds.select("kind", "host", kept.alias("mass"), kept.alias("step"), F.lit(True).alias("old")), "seeds")
    rounds, more = 0, not both.isEmpty()
    while more:
        if rounds >= limit:
            raise RuntimeError(f"verdicts of hosts are still open after {rounds} rounds")
        for _ in range(min(STEP, limit - rounds)):
            moved = state.where("step > 0").join(both, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("step") * F.col("share") * damping).alias("mass"))
            both_ways = state.select("kind", "host", "mass", F.lit(0.0).alias("step"), F.lit(True).alias("old")).union(moved.select("kind", "host", "mass", "mass", F.lit(False)))
            state = both_ways.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("step").alias("step"), F.max("old").alias("old"))
            rounds += 1
        state = staged(state, "ranks")
        more = _open(state, damping)
    return _masses(state)


def judge(pages: DataFrame, rules: list[tuple] = RULES, limit: int = LIMIT) -> DataFrame:
    """page_id, host, path, rule and verdict for each row of pages (page_id, url, html).

    The longest rule that fits decides. A host of which rules allow more than half of the pages is trusted, one of
    which they block more than half a blocked seed; links in pages make weighted edges between hosts. Where
    no rule fits, a host whose distrust exceeds its trust is blocked, any other allowed. Edges are counted before
    the shuffle, so a page or host with a third of all links moves one row per host pair and partition.
    Null urls, or urls without ://, have an empty host and path; null html has no links. Repeated rows stay rows, and count;
    other columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = pages.withColumn("rule", rule).withColumn("verdict", verdict)
    links = pages.where("host <> ''").select("host", F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("to"))
    edges = links.select(F.col("host").alias("src"), F.translate("to", _UPPER, _LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    edges = staged(edges, "links")
    share = lambda v: F.count(F.when(F.col("verdict") == v, 1)) / F.count("*")
    hosts = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    seeds = hosts.select("host", F.when(F.col("allowed") > 0.5, "trust").when(F.col("blocked") > 0.5, "distrust").alias("kind"), F.lit(1.0).alias("mass")).where("kind is not null")
    masses = propagate(edges, seeds, limit)
    bad = staged(masses.where(F.col("distrust") > F.col("trust") * (1 + TIE)).select("host"), "bad").withColumn("bad", F.lit(True))
    out = ruled.drop("html").join(bad, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in cases]
    pick = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values)) + " END"
    rounds = "".join(
        f""",
k{i + 1} AS MATERIALIZED (SELECT kind, host, sum(mass) AS mass FROM (SELECT kind, host, mass * {1 - DAMPING!r} AS mass FROM seeds
  UNION ALL SELECT k.kind, b.dst, k.mass * b.share * {DAMPING} FROM k{i} k JOIN b ON b.kind = k.kind AND b.host = k.host) GROUP BY 1, 2)"""
        for i in range(ROUNDS)
    )
    return rf"""
WITH p AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT page_id, html, host, path, {pick([h + p for _, h, p in cases])} AS rule, {pick([v for v, _, _ in cases])} AS ruled FROM p),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)href\s*=\s*["''](?:https?:)?//([^"''/?#\s]+)', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM r WHERE host <> ''),
e AS (SELECT src, dst, count(*) AS w FROM l WHERE src <> dst GROUP BY 1, 2),
b2 AS (SELECT 'trust' AS kind, src AS host, dst, w FROM e UNION ALL SELECT 'distrust', dst, src, w FROM e),
b AS (SELECT kind, host, dst, w / sum(w) OVER (PARTITION BY kind, host) AS share FROM b2),
s AS (SELECT host, count(*) FILTER (ruled = 'allow') / count(*) AS a, count(*) FILTER (ruled = 'block') / count(*) AS z FROM r WHERE host <> '' GROUP BY 1),
seeds AS (SELECT CASE WHEN a > 0.5 THEN 'trust' ELSE 'distrust' END AS kind, host, 1.0::DOUBLE AS mass FROM s WHERE a > 0.5 OR z > 0.5),
k0 AS (SELECT kind, host, mass * {1 - DAMPING!r} AS mass FROM seeds){rounds},
m AS (SELECT host FROM k{ROUNDS} GROUP BY 1 HAVING round(sum(CASE WHEN kind = 'distrust' THEN mass ELSE 0 END), 9) > round(sum(CASE WHEN kind = 'trust' THEN mass ELSE 0 END), 9))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM m) THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""


OP9_SQL = _sql()
