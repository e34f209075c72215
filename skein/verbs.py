"""Queries on references, sets, rankings and lints by name, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.catalog import PRELUDE
from skein.operators import clones, lints, lookups, sets
from skein.sources.graph import from_star, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, PRELUDE + sql
        return f

    return add


_PATHS = ", pth AS (SELECT DISTINCT regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages), wq AS (SELECT DISTINCT string_split(path, '/')[-1] AS q FROM pth)"


@query(_PATHS + " SELECT q, count(path) AS n, CASE WHEN count(path) = 1 THEN min(path) END AS path, CASE WHEN count(path) = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome FROM wq JOIN pth ON path = q OR ends_with(path, '/' || q) GROUP BY 1")
def resolve_file(spark, sf):
    paths = table(spark, sf, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    return lookups.resolve_files(paths, paths.select(F.substring_index("path", "/", -1).alias("q")))


_CUST = ", cn AS (SELECT 'c' || c_custkey AS id, n_name AS file, c_mktsegment AS kind, 'n' || c_custkey % 7 AS name, c_custkey % 3 AS witness, row_number() OVER (PARTITION BY n_name, c_mktsegment, c_custkey % 7 ORDER BY c_custkey) AS ordinal FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _symbols(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    rows = c.select(F.concat(F.lit("c"), key.cast("string")).alias("id"), F.col("n_name").alias("file"), F.col("c_mktsegment").alias("kind"), F.concat(F.lit("n"), (key % 7).cast("string")).alias("name"), (key % 3).alias("witness"), key.alias("line"))
    return lookups.sibling_ordinal(rows, ["line"])


@query(_CUST + " SELECT id, file, kind, name, ordinal FROM cn")
def sibling_ordinal(spark, sf):
    return _symbols(spark, sf).select("id", "file", "kind", "name", "ordinal")


@query(_CUST + """, j AS (SELECT r.id AS ref, count(n.id) AS n, min(n.id) AS i, count(*) FILTER (r.witness = n.witness) AS nw, min(n.id) FILTER (r.witness = n.witness) AS iw, count(*) FILTER (r.ordinal = n.ordinal) AS no, min(n.id) FILTER (r.ordinal = n.ordinal) AS io FROM cn r JOIN cn n USING (file, kind, name) GROUP BY 1)
SELECT ref, CASE WHEN n = 1 THEN i WHEN nw = 1 THEN iw WHEN no = 1 THEN io END AS id, CASE WHEN n = 1 THEN 'name' WHEN nw = 1 THEN 'witness' WHEN no = 1 THEN 'ordinal' ELSE 'ambiguous' END AS how FROM j""")
def ref_resolve(spark, sf):
    s = _symbols(spark, sf)
    return lookups.resolve_refs(s.withColumnRenamed("id", "ref"), s)


_FLAGS = """, fl AS (SELECT src, dst, bool_or(line % 5 = 0) AS xlang, bool_or(line % 3 = 0) AS typed, bool_or(line = 1) AS declared FROM (SELECT fn AS src, callee AS dst, line FROM calls) GROUP BY 1, 2)"""


def _flags(spark, sf) -> DataFrame:
    any_ = lambda test, name: F.bool_or(F.expr(test)).alias(name)
    return from_star(spark, sf).calls.groupBy(F.col("fn").alias("src"), F.col("callee").alias("dst")).agg(any_("line % 5 = 0", "xlang"), any_("line % 3 = 0", "typed"), any_("line = 1", "declared"))


@query(_FLAGS + " SELECT src, dst, CASE WHEN xlang THEN 'xlang' WHEN typed THEN 'typed' WHEN declared THEN 'declared' ELSE 'matched' END AS tier FROM fl")
def edge_tiers(spark, sf):
    f = _flags(spark, sf)
    return f.select("src", "dst", lookups.tier_of({n: F.col(n) for n in ("xlang", "typed", "declared")}).alias("tier"))


_RUNG = _FLAGS + """, rg AS (SELECT CASE WHEN target IS NOT NULL THEN CASE WHEN xlang THEN 'proven' WHEN typed THEN 'typed' WHEN declared THEN 'declared' WHEN edges.tier = 'inferred' THEN 'inferred' ELSE 'linked' END
  WHEN calls.line % 4 = 0 THEN 'dynamic' WHEN rule IS NOT NULL THEN 'refused' ELSE 'frontier' END AS rung FROM calls LEFT JOIN fl ON fn = fl.src AND callee = fl.dst LEFT JOIN edges ON edges.kind = 'ref' AND fn = edges.src AND target = edges.dst)"""


@query(_RUNG + " SELECT rung, count(*) AS n, floor(count(*) / (SELECT count(*) FROM rg) * 1000 + 0.5) / 10 AS pct FROM rg GROUP BY 1")
def ladder_shares(spark, sf):
    g = from_star(spark, sf)
    f = _flags(spark, sf).withColumnRenamed("src", "fn").withColumnRenamed("dst", "callee")
    e = g.edges.where("kind = 'ref'").select(F.col("src").alias("fn"), F.col("dst").alias("target"), (F.col("tier") == "inferred").alias("inferred"))
    j = g.calls.join(f, ["fn", "callee"], "left").join(e, ["fn", "target"], "left")
    flags = {"inferred": F.col("inferred"), "declared": F.col("declared"), "typed": F.col("typed"), "proven": F.col("xlang")}
    rung = lookups.rung(F.col("target"), flags, F.col("line") % 4 == 0, F.when(F.col("rule").isNotNull(), 1).otherwise(0))
    return lookups.shares(j.groupBy(rung.alias("rung")).agg(F.count("*").alias("n")))


@query(" SELECT callee, fn AS caller, count(*) AS n, string_agg(DISTINCT coalesce(rule, 'link'), ',' ORDER BY coalesce(rule, 'link')) AS provs FROM calls GROUP BY 1, 2")
def callers_provenance(spark, sf):
    calls = from_star(spark, sf).calls.select("callee", F.col("fn").alias("caller"), F.coalesce("rule", F.lit("link")).alias("prov"))
    return lookups.provenance(calls, ["callee", "caller"], "prov")


@query(" SELECT file, callee, count(*) AS n, string_agg(DISTINCT coalesce(rule, 'link'), ',' ORDER BY coalesce(rule, 'link')) AS provs FROM calls GROUP BY 1, 2")
def axis_file(spark, sf):
    return lookups.provenance(from_star(spark, sf).calls.withColumn("prov", F.coalesce("rule", F.lit("link"))), ["file", "callee"], "prov")


@query(" SELECT coalesce(rule, 'link') AS prov, count(*) AS n, count(DISTINCT fn) AS n_fns, count(DISTINCT file) AS n_files FROM calls GROUP BY 1")
def axis_prov(spark, sf):
    return from_star(spark, sf).calls.groupBy(F.coalesce("rule", F.lit("link")).alias("prov")).agg(F.count("*").alias("n"), F.countDistinct("fn").alias("n_fns"), F.countDistinct("file").alias("n_files"))


@query(" SELECT file, count(*) AS n, count(*) FILTER (kind = 'function') AS n_functions, min(id) AS first FROM nodes GROUP BY 1")
def nodes_of(spark, sf):
    return from_star(spark, sf).nodes.groupBy("file").agg(F.count("*").alias("n"), F.count(F.when(F.col("kind") == "function", 1)).alias("n_functions"), F.min("id").alias("first"))


@query(" SELECT n.file, count(*) AS n_calls, count(*) FILTER (t.file = n.file) AS n_inside FROM refs JOIN nodes n ON n.id = src JOIN nodes t ON t.id = dst GROUP BY 1")
def cut_files(spark, sf):
    g = from_star(spark, sf)
    at = g.nodes.select("id", "file")
    j = g.refs().join(at.toDF("src", "file"), "src").join(at.toDF("dst", "to"), "dst")
    return j.groupBy("file").agg(F.count("*").alias("n_calls"), F.count(F.when(F.col("to") == F.col("file"), 1)).alias("n_inside"))


@query(" SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND contains(text, 'license')")
def frontier_find(spark, sf):
    return table(spark, sf, "documents").where(F.contains("text", F.lit("license"))).join(table(spark, sf, "labels"), "doc_id", "anti").select("doc_id")


_CHAIN = """, l1 AS (SELECT c_custkey AS s, o_orderkey AS a FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'), l2 AS (SELECT DISTINCT s, l_partkey AS b, a FROM l1 LEFT JOIN lineitem ON l_orderkey = a AND l_returnflag = 'R' WHERE a IS NOT NULL)"""


@query(_CHAIN + """ SELECT s AS start, 1 AS step, count(*) AS reached, 'absent' AS absence FROM l1 WHERE a IS NULL GROUP BY 1
UNION ALL SELECT s, 2, count(*), 'frontier' FROM l2 WHERE b IS NULL GROUP BY 1 UNION ALL SELECT s, 2, count(DISTINCT b), NULL FROM l2 WHERE b IS NOT NULL GROUP BY 1""")
def link_chain(spark, sf):
    start = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    orders = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    parts = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return lookups.chain(start, [(orders, True), (parts, False)])


@query(" SELECT CASE WHEN o_custkey % 2 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey, count(*) AS n FROM orders GROUP BY 1")
def cascade_update(spark, sf):
    edits = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1000000).alias("new"))
    return lookups.cascade_update(table(spark, sf, "orders"), "o_custkey", edits).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query(" SELECT p_partkey AS key, (pos - 1)::INT AS pos, words[pos] AS member FROM (SELECT p_partkey, string_split(p_type, ' ') AS words, unnest(range(1, len(string_split(p_type, ' ')) + 1)) AS pos FROM part)")
def normalize(spark, sf):
    return lookups.unnest(table(spark, sf, "part"), "p_partkey", F.split("p_type", " "))


_TABLES = ", cd AS (SELECT DISTINCT 't' || l_suppkey AS name FROM lineitem), sc AS (SELECT DISTINCT CASE WHEN s_suppkey % 10 = 3 THEN 'other' || s_suppkey ELSE 'app_t' || s_suppkey END AS name FROM supplier)"


def _tables(spark, sf):
    code = table(spark, sf, "lineitem").select(F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("name"))
    key = F.col("s_suppkey").cast("string")
    return code, table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 10 == 3, F.concat(F.lit("other"), key)).otherwise(F.concat(F.lit("app_t"), key)).alias("name"))


@query(_TABLES + " SELECT regexp_extract(name, '^([^_]*_)', 1) AS prefix, count(*) AS n, (SELECT count(*) FROM sc) AS total FROM sc WHERE contains(name, '_') GROUP BY 1 HAVING 2 * count(*) > (SELECT count(*) FROM sc)")
def prefix_detection(spark, sf):
    return lookups.prefix_of(_tables(spark, sf)[1])


@query(_TABLES + """ SELECT cd.name, sc.name AS found, count(sc.name) AS n, CASE WHEN sc.name IS NULL THEN 'missing' ELSE 'matched' END AS outcome FROM cd LEFT JOIN sc ON sc.name = 'app_' || cd.name GROUP BY 1, 2
UNION ALL SELECT name, NULL, 0, 'unused' FROM sc WHERE name NOT IN (SELECT 'app_' || name FROM cd)""")
def dblink_tables(spark, sf):
    return lookups.link_tables(*_tables(spark, sf))


_WIRE = ", st AS (SELECT '/shop.' || l_shipmode || '/' || l_linenumber AS path FROM (SELECT 'S' || l_suppkey % 20 AS l_shipmode, l_linenumber FROM lineitem)), mt AS (SELECT '/shop.S' || s_suppkey % 25 || '/' || s_suppkey % 5 AS path FROM supplier)"


@query(_WIRE + " SELECT path, coalesce(a.n, 0) AS n_stubs, coalesce(b.n, 0) AS n_methods, CASE WHEN b.n IS NULL THEN 'undeclared' WHEN a.n IS NULL THEN 'uncalled' ELSE 'linked' END AS outcome FROM (SELECT path, count(*) AS n FROM st GROUP BY 1) a FULL JOIN (SELECT path, count(*) AS n FROM mt GROUP BY 1) b USING (path)")
def contract_join(spark, sf):
    path = lambda a, b: F.concat(F.lit("/shop.S"), a.cast("string"), F.lit("/"), b.cast("string")).alias("path")
    return lookups.contract(table(spark, sf, "lineitem").select(path(F.col("l_suppkey") % 20, F.col("l_linenumber"))), table(spark, sf, "supplier").select(path(F.col("s_suppkey") % 25, F.col("s_suppkey") % 5)))


@query(", ob AS (SELECT DISTINCT fn AS src, 's' || (substr(callee, 2)::BIGINT + line % 2) AS dst FROM calls), st AS (SELECT DISTINCT src, dst FROM refs WHERE src[1] = 'o') SELECT src, dst, CASE WHEN st.src IS NULL THEN 'recovered' WHEN ob.src IS NOT NULL THEN 'confirmed' ELSE 'static' END AS outcome FROM (SELECT src, dst FROM st UNION SELECT src, dst FROM ob) u LEFT JOIN st USING (src, dst) LEFT JOIN ob USING (src, dst)")
def confirm_overlay(spark, sf):
    g = from_star(spark, sf)
    seen = g.calls.select(F.col("fn").alias("src"), F.concat(F.lit("s"), (F.substring("callee", 2, 20).cast("long") + F.col("line") % 2).cast("string")).alias("dst"))
    return lookups.overlay(g.refs().where("src like 'o%'"), seen)


_BANDS = ", ix AS (SELECT DISTINCT c_nationkey AS band, 'k' || c_custkey % 400 AS name, c_custkey AS id FROM customer), wb AS (SELECT DISTINCT s_nationkey AS band, 'k' || s_suppkey % 500 AS name FROM supplier)"


@query(_BANDS + """, ow AS (SELECT band, name, count(*) AS n, min(id) AS id FROM ix GROUP BY 1, 2), al AS (SELECT name, count(*) AS n, min(id) AS id FROM ix GROUP BY 1)
SELECT wb.band, wb.name, CASE WHEN ow.n = 1 THEN ow.id WHEN ow.n IS NULL AND al.n = 1 THEN al.id END AS id, CASE WHEN ow.n = 1 THEN 'band' WHEN ow.n IS NULL AND al.n = 1 THEN 'unique' WHEN al.n > 0 THEN 'refused' ELSE 'missing' END AS how FROM wb LEFT JOIN ow USING (band, name) LEFT JOIN al ON al.name = wb.name""")
def band_resolve(spark, sf):
    name = lambda key, n: F.concat(F.lit("k"), (F.col(key) % n).cast("string")).alias("name")
    index = table(spark, sf, "customer").select(F.col("c_nationkey").alias("band"), name("c_custkey", 400), F.col("c_custkey").alias("id"))
    return lookups.band_resolve(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("band"), name("s_suppkey", 500)), index)


_PORT = ", pc AS (SELECT c_nationkey::VARCHAR AS file, 's' || l_suppkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_linestatus = 'F'), pb AS (SELECT 's' || s_suppkey AS target, s_nationkey::VARCHAR AS band FROM supplier), pj AS (SELECT file, band, target FROM pc JOIN pb USING (target) WHERE band <> file)"


@query(_PORT + " SELECT band, coalesce(p, 0) AS provides, coalesce(n, 0) AS needs FROM (SELECT band, count(DISTINCT target) AS p FROM pj GROUP BY 1) FULL JOIN (SELECT file AS band, count(DISTINCT target) AS n FROM pj GROUP BY 1) USING (band)")
def port_surface(spark, sf):
    t = lambda name: table(spark, sf, name)
    key = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    calls = t("lineitem").where("l_linestatus = 'F'").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("string").alias("file"), key("l_suppkey").alias("target"))
    return lookups.ports(calls, t("supplier").select(key("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("band")))


@query(", rq AS (SELECT DISTINCT callee AS name FROM calls WHERE target IS NULL), pf AS (SELECT DISTINCT file AS profile, callee AS name FROM calls WHERE target IS NOT NULL AND line = 1) SELECT profile, count(*) FILTER (name IN (SELECT name FROM rq)) AS provided, (SELECT count(*) FROM rq) - count(*) FILTER (name IN (SELECT name FROM rq)) AS unknown, floor(count(*) FILTER (name IN (SELECT name FROM rq)) / (SELECT count(*) FROM rq) * 1000 + 0.5) / 10 AS pct FROM pf GROUP BY 1")
def profile_coverage(spark, sf):
    calls = from_star(spark, sf).calls
    return lookups.coverage(calls.where("target is null").select(F.col("callee").alias("name")), calls.where("target is not null and line = 1").select(F.col("file").alias("profile"), F.col("callee").alias("name")))


@query(" SELECT callee AS name, file, fn, line, CASE WHEN h AND NOT t THEN 'lost' WHEN NOT h AND t THEN 'gained' WHEN h AND t THEN 'kept' ELSE 'neither' END AS verdict FROM (SELECT *, callee IN (SELECT callee FROM calls WHERE file = '1995' AND rule = 'blocked') AS h, callee IN (SELECT callee FROM calls WHERE file = '1996' AND rule = 'ambiguous') AS t FROM calls WHERE target IS NULL)")
def portability_sites(spark, sf):
    calls = from_star(spark, sf).calls
    at = lambda year, rule: calls.where((F.col("file") == year) & (F.col("rule") == rule)).select(F.col("callee").alias("name"))
    return lookups.site_verdicts(calls.where("target is null").select(F.col("callee").alias("name"), "file", "fn", "line"), at("1995", "blocked"), at("1996", "ambiguous"))


@query(" SELECT 's' || l_suppkey AS target, 'o' || l_orderkey AS fn, year(l_shipdate)::VARCHAR AS file, l_linenumber::BIGINT AS line, CASE WHEN l_linenumber = 1 THEN 'absent' ELSE 'lit' END AS kind, CASE WHEN l_linenumber > 1 THEN l_returnflag END AS value FROM lineitem WHERE l_linestatus = 'F'")
def trace_origins(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_linestatus = 'F'")
    arg = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.col(value).cast("string").alias("value"))
    args = F.when(F.col("l_linenumber") > 1, F.array(arg("param", "l_quantity"), arg("lit", "l_returnflag"))).otherwise(F.array(arg("param", "l_quantity")))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return lookups.origins(lines.select(key("s", "l_suppkey").alias("target"), key("o", "l_orderkey").alias("fn"), F.year("l_shipdate").cast("string").alias("file"), F.col("l_linenumber").cast("long").alias("line"), args.alias("args")), 1)


@query(", su AS (SELECT callee AS name, file, line, 0 AS k, 'call' AS how FROM calls WHERE target IS NOT NULL UNION ALL SELECT callee, file, line, 1, 'reference' FROM calls WHERE rule IS NOT NULL UNION ALL SELECT callee, file, line, 2, 'read' FROM calls) SELECT name, file, line, arg_min(how, k) AS how FROM su GROUP BY 1, 2, 3")
def sites_union(spark, sf):
    c = from_star(spark, sf).calls.withColumnRenamed("callee", "name")
    return lookups.sites_union(("call", c.where("target is not null")), ("reference", c.where("rule is not null")), ("read", c))


@query(" SELECT base, count(*) AS n_calls, count(DISTINCT member) AS n_members, count(*) FILTER (member IS NULL) AS n_bare FROM (SELECT CASE WHEN regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*[.:].+$') THEN regexp_extract(name, '^([A-Za-z_][A-Za-z0-9_]*)[.:](.+)$', 1) ELSE name END AS base, CASE WHEN regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*[.:].+$') THEN regexp_extract(name, '^([A-Za-z_][A-Za-z0-9_]*)[.:](.+)$', 2) END AS member FROM nodes) GROUP BY 1")
def externals_split(spark, sf):
    base, member = lookups.base_member(F.col("name"))
    n = from_star(spark, sf).nodes.select(base.alias("base"), member.alias("member"))
    return n.groupBy("base").agg(F.count("*").alias("n_calls"), F.countDistinct("member").alias("n_members"), F.count(F.when(F.col("member").isNull(), 1)).alias("n_bare"))


_YEARS = ", cy AS (SELECT year(l_shipdate) AS y, l_suppkey AS s, l_partkey AS p, l_linestatus AS outcome, l_linenumber FROM lineitem)"


def _years(spark, sf, y: int) -> DataFrame:
    return table(spark, sf, "lineitem").where(F.year("l_shipdate") == y)


@query(_YEARS + ", b AS (SELECT s, outcome, count(*) AS n FROM cy WHERE y = 1995 GROUP BY 1, 2), a AS (SELECT s, outcome, count(*) AS n FROM cy WHERE y = 1996 GROUP BY 1, 2) SELECT s, outcome, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after FROM b FULL JOIN a USING (s, outcome) WHERE coalesce(b.n, 0) <> coalesce(a.n, 0)")
def census_diff(spark, sf):
    at = lambda y: _years(spark, sf, y).groupBy(F.col("l_suppkey").alias("s"), F.col("l_linestatus").alias("outcome")).agg(F.count("*").alias("n"))
    return sets.keyed_diff(at(1995), at(1996), ["s"])


@query(_YEARS + ", b AS (SELECT s, list_sort(list(DISTINCT l_linenumber)) AS l FROM cy WHERE y = 1995 GROUP BY 1), a AS (SELECT s, list_sort(list(DISTINCT l_linenumber)) AS l FROM cy WHERE y = 1996 GROUP BY 1) SELECT s AS file, CASE WHEN a.l IS NULL OR b.l IS NULL THEN 'not compared' WHEN a.l = b.l THEN 'same' ELSE 'changed' END AS outcome FROM b FULL JOIN a USING (s)")
def mention_diff(spark, sf):
    at = lambda y: _years(spark, sf, y).select(F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("name"))
    return sets.set_diff(at(1995), at(1996))


_DELTA = _YEARS + """, sd AS (SELECT s, l_linenumber AS kind, p, max((y = 1995)::INT) AS b, max((y = 1996)::INT) AS a FROM cy WHERE y IN (1995, 1996) GROUP BY 1, 2, 3), sx AS (SELECT s AS file, kind, sum(a)::BIGINT AS x, sum(b)::BIGINT AS z FROM sd WHERE a <> b GROUP BY 1, 2),
sr AS (SELECT file, kind, CASE WHEN x = 1 AND z = 1 THEN 0 ELSE x END AS added, CASE WHEN x = 1 AND z = 1 THEN 0 ELSE z END AS removed, (x = 1 AND z = 1)::INT AS renamed FROM sx)"""


def _delta(spark, sf) -> DataFrame:
    at = lambda y: _years(spark, sf, y).select(F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("kind"), F.col("l_partkey").alias("name"))
    return sets.structural_delta(at(1995), at(1996))


@query(_DELTA + " SELECT * FROM sr")
def structural_delta(spark, sf):
    return _delta(spark, sf)


@query(_DELTA + " SELECT file, kind, CASE WHEN added = 0 AND removed = 0 AND renamed = 0 THEN CASE WHEN kind % 2 = 0 THEN 'rewire' ELSE 'internal' END WHEN added = 0 AND removed = 0 THEN 'rename' WHEN removed = 0 THEN 'extract' WHEN added = 0 THEN 'inline' ELSE 'restructure' END AS operation FROM sr")
def delta_classify(spark, sf):
    c = F.col
    return _delta(spark, sf).select("file", "kind", sets.operation(c("added"), c("removed"), c("renamed"), c("kind") % 2 == 0).alias("operation"))


@query(", pp AS (SELECT DISTINCT p_brand AS a, p_type AS b FROM part) SELECT (SELECT count(DISTINCT a) FROM pp) AS n_a, (SELECT count(DISTINCT b) FROM pp) AS n_b, (SELECT count(*) FROM (SELECT a FROM pp GROUP BY 1 HAVING count(*) > 1)) AS split, (SELECT count(*) FROM (SELECT b FROM pp GROUP BY 1 HAVING count(*) > 1)) AS merged, NOT EXISTS (SELECT a FROM pp GROUP BY a HAVING count(*) > 1) AND NOT EXISTS (SELECT b FROM pp GROUP BY b HAVING count(*) > 1) AS same")
def partition_join(spark, sf):
    return sets.partition_join(table(spark, sf, "part"), "p_brand", "p_type")


@query(", dx AS (SELECT dst, src FROM refs WHERE n = 1), lx AS (SELECT dst, src FROM refs WHERE tier <> 'inferred') SELECT 'missing' AS side, count(*) AS n FROM (SELECT * FROM dx EXCEPT ALL SELECT * FROM lx) UNION ALL SELECT 'stale', count(*) FROM (SELECT * FROM lx EXCEPT ALL SELECT * FROM dx)")
def index_audit(spark, sf):
    r = from_star(spark, sf).refs()
    return sets.index_audit(r.where("n = 1").select("dst", "src"), r.where("tier <> 'inferred'").select("dst", "src"))


@query(", ly AS (SELECT user_id AS path, event_id AS layer, event_type AS value FROM events), lm AS (SELECT *, lag(value) OVER (PARTITION BY path ORDER BY layer) AS p, row_number() OVER (PARTITION BY path ORDER BY layer) = 1 AS f FROM ly) SELECT path, arg_max(value, layer) AS value, max(layer) AS layer, count(*) FILTER (NOT f) AS n_overrides, count(*) FILTER (NOT f AND p IS NOT DISTINCT FROM value) AS n_noops FROM lm GROUP BY 1")
def value_merge(spark, sf):
    return sets.layered(table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("layer"), F.col("event_type").alias("value")))


@query(", dm AS (SELECT c_nationkey AS family, c_custkey % 5 AS path, c_custkey AS member, c_mktsegment AS value FROM customer), dc AS (SELECT family, path, value, count(*) AS n FROM dm GROUP BY ALL), du AS (SELECT family, path, count(*) AS kinds, (list(value ORDER BY n DESC, value))[1] AS usual FROM dc GROUP BY 1, 2) SELECT family, path, member, value, CASE WHEN kinds = 2 THEN 'lone' ELSE 'varied' END AS kind FROM dm JOIN du USING (family, path) WHERE value <> usual")
def drift_observe(spark, sf):
    key = F.col("c_custkey")
    return sets.drift(table(spark, sf, "customer").select(F.col("c_nationkey").alias("family"), (key % 5).alias("path"), key.alias("member"), F.col("c_mktsegment").alias("value")))


@query(" SELECT rule, file, fn, line, rank FROM (SELECT rule, file, fn, line, row_number() OVER (PARTITION BY rule ORDER BY file, fn, line) AS rank FROM calls WHERE rule IS NOT NULL) WHERE rank <= 3")
def top_examples(spark, sf):
    return sets.top_examples(from_star(spark, sf).calls.where("rule is not null").select("rule", "file", "fn", "line"), ["rule"], ["file", "fn", "line"])


@query(", iw AS (SELECT l_orderkey AS fn, l_linenumber AS line, l_returnflag AS concern, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS t FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)), sp AS (SELECT fn, max(s) AS span FROM (SELECT fn, concern, max(line) - min(line) AS s FROM iw GROUP BY 1, 2) GROUP BY 1) SELECT fn, count(*) AS n, count(*) FILTER (t <> concern) AS switches, any_value(span) AS span FROM iw JOIN sp USING (fn) GROUP BY 1")
def interleave(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").alias("line")).agg(F.min("l_returnflag").alias("concern"))
    return sets.interleave(rows)


@query(", us AS (SELECT DISTINCT c_nationkey AS file, c_mktsegment || c_custkey % 9 AS name FROM customer), df AS (SELECT DISTINCT s_nationkey AS file, 'BUILDING' || s_suppkey % 9 AS name FROM supplier) SELECT DISTINCT us.name, us.file AS user, df.file AS owner FROM us JOIN df USING (name) JOIN nation x ON x.n_nationkey = us.file JOIN nation y ON y.n_nationkey = df.file WHERE x.n_name < y.n_name")
def load_order(spark, sf):
    n9 = lambda c: (F.col(c) % 9).cast("string")
    uses = table(spark, sf, "customer").select(F.col("c_nationkey").alias("file"), F.concat("c_mktsegment", n9("c_custkey")).alias("name")).distinct()
    owned = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("file"), F.concat(F.lit("BUILDING"), n9("s_suppkey")).alias("name")).distinct()
    return sets.load_order(uses, owned, table(spark, sf, "nation").select(F.col("n_nationkey").alias("file"), F.col("n_name").alias("position")))


@query(" SELECT o_orderdate, o_totalprice, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT o_orderdate, NULL, count(*) FROM orders GROUP BY 1 HAVING count(*) > 1")
def tie_witness(spark, sf):
    o = table(spark, sf, "orders")
    return sets.ties(o, ["o_orderdate", "o_totalprice"]).unionByName(sets.ties(o, ["o_orderdate"]).withColumn("o_totalprice", F.lit(None).cast("double")))


@query(" SELECT c_nationkey AS file, c_mktsegment || c_custkey % 40 AS name, min(c_custkey) AS value FROM customer GROUP BY 1, 2 HAVING count(*) = 1")
def constant_bindings(spark, sf):
    return sets.constants(table(spark, sf, "customer").select(F.col("c_nationkey").alias("file"), F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string")).alias("name"), F.col("c_custkey").alias("value")))


@query(" SELECT l_suppkey AS target, l_linenumber AS i, CASE WHEN count(CASE WHEN l_returnflag <> 'A' THEN 1 END) = 0 THEN 'unknown' WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'never' WHEN count(*) FILTER (l_returnflag = 'R') = count(CASE WHEN l_returnflag <> 'A' THEN 1 END) THEN 'always' ELSE 'maybe' END AS label FROM lineitem GROUP BY 1, 2")
def param_nilability(spark, sf):
    nil = F.when(F.col("l_returnflag") != "A", F.col("l_returnflag") == "R")
    return sets.nilability(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("target"), F.col("l_linenumber").alias("i"), nil.alias("nil")))


@query(""", wr AS (SELECT DISTINCT src AS fn, dst AS key, 1 AS tier FROM edges WHERE kind = 'use' AND rw IN (2, 3)), rd AS (SELECT DISTINCT src AS fn, dst AS key FROM edges WHERE kind = 'use' AND rw IN (1, 3)), od AS (SELECT 'o' || o_orderkey AS b, 'o' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a FROM orders), pr AS (SELECT a, b FROM od WHERE a IS NOT NULL)
SELECT a, b, CASE WHEN EXISTS (SELECT 1 FROM wr x JOIN wr y USING (key) WHERE x.fn = a AND y.fn = b) OR EXISTS (SELECT 1 FROM wr x JOIN rd y USING (key) WHERE x.fn = a AND y.fn = b) OR EXISTS (SELECT 1 FROM rd x JOIN wr y USING (key) WHERE x.fn = a AND y.fn = b) THEN 'conflict' ELSE 'commute' END AS verdict FROM pr""")
def commutativity(spark, sf):
    from pyspark.sql import Window

    uses = from_star(spark, sf).edges.where("kind = 'use'")
    of = lambda *rw: uses.where(F.col("rw").isin(*rw)).select(F.col("src").alias("fn"), F.col("dst").alias("key")).distinct()
    name = lambda c: F.concat(F.lit("o"), c.cast("string"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pairs = table(spark, sf, "orders").select(name(before).alias("a"), name(F.col("o_orderkey")).alias("b")).where("a is not null")
    return sets.commutes(of(2, 3).withColumn("tier", F.lit(1)), of(1, 3), pairs)


@query(", bk AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS key FROM lineitem), bn AS (SELECT key, count(*) AS n FROM bk GROUP BY 1) SELECT id, min(n) AS least FROM bk JOIN bn USING (key) GROUP BY 1 HAVING min(n) > 30")
def index_blind_spot(spark, sf):
    return sets.blind_spot(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("key")), clones.POST_CAP)


@query(", jw AS (SELECT doc_id, list_distinct(list(word)) AS ws FROM words GROUP BY 1) SELECT x.doc_id AS a, y.doc_id AS b, 1 - len(list_intersect(x.ws, y.ws)) / len(list_distinct(list_concat(x.ws, y.ws))) AS distance FROM jw x JOIN jw y ON y.doc_id = x.doc_id + 1")
def jaccard_distance(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.array_distinct(clones.words(F.col("text"))).alias("ws")).where("size(ws) > 0")
    j = d.toDF("a", "x").join(d.select(F.col("doc_id").alias("b"), F.col("ws").alias("y"), (F.col("doc_id") - 1).alias("a")), "a")
    return j.select("a", "b", sets.jaccard(F.col("x"), F.col("y")).alias("distance"))


@query(", hb AS (SELECT DISTINCT n_name AS name FROM nation), hs AS (SELECT name, list_transform(range(1, length(name) + 1), lambda i: ord(name[i])::BIGINT) AS cs FROM hb) SELECT name, list_reduce(list_prepend(5381::BIGINT, cs), lambda h, c: (h * 33 + c) % 4294967296) AS h FROM hs")
def name_hash(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("name")).distinct().select("name", sets.djb2(F.col("name")).alias("h"))


_LINT = """, uf AS (SELECT c.file, n.file AS owner, count(*) AS n FROM calls c JOIN nodes n ON n.id = c.target WHERE n.file <> c.file GROUP BY 1, 2), im AS (SELECT src, m.file, o.file AS owner FROM edges JOIN nodes m ON m.id = src JOIN nodes o ON o.id = dst WHERE edges.kind = 'import'), ac AS (SELECT DISTINCT a.file, b.file AS owner FROM refs JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst),
li AS (SELECT 'dead-function' AS rule, 'promise' AS quantifier, id AS subject, 0::BIGINT AS n FROM nodes WHERE kind = 'function' AND entry IS NULL AND id NOT IN (SELECT dst FROM refs)
UNION ALL SELECT 'dead-state', 'promise', dst, count(*) FILTER (rw IN (2, 3)) FROM edges WHERE kind = 'use' GROUP BY dst HAVING count(*) FILTER (rw IN (2, 3)) > 0 AND count(*) FILTER (rw IN (1, 3)) = 0 AND count(*) FILTER (rw IS NULL) = 0
UNION ALL SELECT 'access-point', 'witness', dst, count(DISTINCT src) FROM refs r WHERE (SELECT count(DISTINCT dst) FROM refs o WHERE o.src = r.dst) <= 2 GROUP BY dst HAVING count(DISTINCT src) >= 15
UNION ALL SELECT 'silent-drop', 'witness', fn, count(*) FROM calls WHERE target IS NULL AND rule IS NULL GROUP BY fn
UNION ALL SELECT 'dynamic-dispatch', 'witness', file, count(*) FROM calls WHERE target IS NULL AND rule IS NULL GROUP BY file
UNION ALL SELECT 'redefined-function', 'witness', file || '::' || name, count(*) FROM nodes WHERE kind = 'function' GROUP BY file, name HAVING count(*) > 1
UNION ALL SELECT 'swallowed-type', 'witness', dst, sum(n)::BIGINT FROM edges WHERE kind = 'ref' AND tier = 'inferred' GROUP BY dst
UNION ALL SELECT 'use-without-require', 'promise', file || ' -> ' || owner, n FROM uf WHERE (file, owner) NOT IN (SELECT file, owner FROM im)
UNION ALL SELECT 'redundant-require', 'promise', src, count(*) FROM im WHERE (file, owner) NOT IN (SELECT file, owner FROM ac) GROUP BY src)"""


@query(_LINT + " SELECT * FROM li")
def lint_run(spark, sf):
    return lints.run(from_star(spark, sf))


@query(_LINT + " SELECT * FROM li WHERE quantifier = 'witness' OR rule = 'redundant-require'")
def lint_run_file(spark, sf):
    return lints.run(from_star(spark, sf), "file")


_STEPS = ", st AS (SELECT user_id AS fn, props->>'k' AS var, CASE event_type WHEN 'signup' THEN 'acquire' WHEN 'purchase' THEN 'release' END AS op, ts, event_id FROM events WHERE event_type IN ('signup', 'purchase'))"


def _steps(spark, sf) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "acquire").otherwise("release")
    return table(spark, sf, "events").where("event_type in ('signup', 'purchase')").select(F.col("user_id").alias("fn"), F.get_json_object("props", "$.k").alias("var"), op.alias("op"), "ts", "event_id")


@query(_STEPS + " SELECT fn, var, count(*) AS n FROM (SELECT *, lead(op) OVER (PARTITION BY fn, var ORDER BY ts, event_id) AS nx FROM st) WHERE op = 'acquire' AND nx = 'acquire' GROUP BY 1, 2")
def lint_resource_leak(spark, sf):
    return lints.resource_leaks(_steps(spark, sf), ["ts", "event_id"])


@query(_STEPS + ", sv AS (SELECT fn || ':' || var AS var, op FROM st) SELECT var, count(*) AS n FROM sv WHERE op = 'acquire' AND var NOT IN (SELECT var FROM sv WHERE op = 'release') GROUP BY 1")
def lint_member_leak(spark, sf):
    return lints.member_leaks(_steps(spark, sf).withColumn("var", F.concat_ws(":", F.col("fn").cast("string"), "var")))


@query(""", le AS (SELECT user_id || ':' || (props->>'k') AS key, CASE event_type WHEN 'signup' THEN 'register' WHEN 'view' THEN 'subscribe' WHEN 'click' THEN 'unsubscribe' END AS op FROM events WHERE event_type IN ('signup', 'view', 'click')), lp AS (SELECT key, max((op = 'register')::INT) AS r, max((op = 'subscribe')::INT) AS s, max((op = 'unsubscribe')::INT) AS u FROM le GROUP BY 1)
SELECT key, 'unregistered' AS finding FROM lp WHERE s = 1 AND r = 0 UNION ALL SELECT key, 'unsubscribed' FROM lp WHERE r = 1 AND s = 0 UNION ALL SELECT key, 'kept' FROM lp WHERE s = 1 AND u = 0""")
def lint_listener_audit(spark, sf):
    op = F.when(F.col("event_type") == "signup", "register").when(F.col("event_type") == "view", "subscribe").otherwise("unsubscribe")
    e = table(spark, sf, "events").where("event_type in ('signup', 'view', 'click')")
    return lints.listener_audit(e.select(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.get_json_object("props", "$.k")).alias("key"), op.alias("op")))


@query(" SELECT DISTINCT p_size % 5 AS family, p_brand AS tag FROM part WHERE p_size <= 40 AND p_size % 5 IN (SELECT p_size % 5 FROM part WHERE p_size > 48) AND (p_size % 5, p_brand) NOT IN (SELECT p_size % 5, p_brand FROM part WHERE p_size > 48)")
def lint_tag_coverage(spark, sf):
    p = table(spark, sf, "part").select((F.col("p_size") % 5).alias("family"), F.col("p_brand").alias("tag"), "p_size")
    return lints.tag_coverage(p.where("p_size <= 40"), p.where("p_size > 48"))


@query(", aw AS (SELECT p_partkey AS id, list_distinct(string_split(p_type, ' ')) AS d, list_distinct(string_split(p_name, ' ')) AS s FROM part) SELECT id, array_to_string(list_sort(list_filter(d, lambda x: NOT list_contains(s, x))), ',') AS missing FROM aw WHERE len(list_filter(d, lambda x: NOT list_contains(s, x))) > 0")
def lint_annotation_mismatch(spark, sf):
    return lints.annotation_mismatch(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.split("p_type", " ").alias("documented"), F.split("p_name", " ").alias("params")))


@query(", ru AS (SELECT 'r' || c_custkey % 97 AS name FROM customer), rr AS (SELECT 'r' || s_suppkey % 60 + s_suppkey // 90 * 50 AS name FROM supplier), ra AS (SELECT name, coalesce(u.n, 0) AS n_used, coalesce(r.n, 0) AS n_registered FROM (SELECT name, count(*) AS n FROM ru GROUP BY 1) u FULL JOIN (SELECT name, count(*) AS n FROM rr GROUP BY 1) r USING (name)) SELECT *, CASE WHEN n_registered = 0 THEN 'unregistered' WHEN n_registered > 1 THEN 'duplicate' ELSE 'unused' END AS finding FROM ra WHERE n_registered <> 1 OR n_used = 0")
def lint_route_audit(spark, sf):
    r = lambda c: F.concat(F.lit("r"), c.cast("string")).alias("name")
    key = F.col("s_suppkey")
    return lints.route_audit(table(spark, sf, "customer").select(r(F.col("c_custkey") % 97)), table(spark, sf, "supplier").select(r(key % 60 + F.floor(key / 90) * 50)))


@query(" SELECT p_brand AS table, count(*) AS n_sites, count(DISTINCT year(l_shipdate)) AS n_files FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) >= 2")
def lint_sql(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lints.raw_sites(j.select(F.col("p_brand").alias("table"), F.year("l_shipdate").alias("file")))
