"""Every query of the library by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import clones, diffs, reach, slices
from skein.operators.registries import near_pairs
from skein.plans.rules import Rule, saturate
from skein.sources.graph import from_star, invalid, table, trade
from skein.streaming.windows import windowed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The derived tables of skein.sources.graph in SQL.
PRELUDE = """WITH RECURSIVE
nodes AS (SELECT 'r' || r_regionkey AS id, r_name AS name, 'module' AS kind, r_name AS file, NULL::VARCHAR AS entry FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'module', n_name, NULL FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, 'function', n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'o' || o_orderkey, 'order.' || o_orderkey, 'function', year(o_orderdate)::VARCHAR, NULL FROM orders
  UNION ALL SELECT 'p' || p_partkey, p_name, 'var', p_brand, NULL FROM part
  UNION ALL SELECT 's' || s_suppkey, s_name, 'var', n_name, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey),
edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'import' AS kind, 1::BIGINT AS n, 'matched' AS tier, NULL::INT AS rw FROM nation
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'ref', 1, 'matched', NULL FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 's' || l_suppkey, 'ref', count(*), CASE WHEN bool_and(l_returnflag = 'N') THEN 'proven' WHEN bool_or(l_returnflag = 'R') THEN 'inferred' ELSE 'matched' END, NULL FROM lineitem GROUP BY l_orderkey, l_suppkey
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'use', count(*), 'matched', CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END FROM lineitem GROUP BY l_orderkey, l_partkey, l_returnflag),
refs AS (SELECT *, CASE tier WHEN 'proven' THEN 2 WHEN 'inferred' THEN 7 ELSE 8 END AS rank FROM edges WHERE kind = 'ref' AND src <> dst),
calls AS (SELECT 'o' || l_orderkey AS fn, 's' || l_suppkey AS callee, year(l_shipdate)::VARCHAR AS file, l_linenumber::BIGINT AS line, CASE WHEN l_linestatus = 'F' THEN 's' || l_suppkey END AS target,
  CASE WHEN l_linestatus = 'F' THEN NULL WHEN l_returnflag = 'A' THEN 'ambiguous' WHEN l_returnflag = 'R' THEN 'blocked' END AS rule FROM lineitem),
trade AS (SELECT src, dst, n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM (
  SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)) WHERE k <= 2),
paths AS (SELECT src AS a, dst AS b FROM trade UNION SELECT p.a, t.dst FROM paths p JOIN trade t ON p.b = t.src),
scc AS (SELECT v AS node, least(v, coalesce((SELECT min(p.b) FROM paths p JOIN paths q ON p.a = q.b AND p.b = q.a WHERE p.a = v), v)) AS component FROM (SELECT src AS v FROM trade UNION SELECT dst FROM trade)),
words AS (SELECT doc_id, lang, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS word FROM documents)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = PRELUDE + sql
        return f

    return add


_TIER = "CASE max(rank) WHEN 2 THEN 'proven' WHEN 7 THEN 'inferred' ELSE 'matched' END"


@query(f"SELECT dst AS node, count(DISTINCT src) AS n_nodes, sum(n)::BIGINT AS n_sites, {_TIER} AS weakest FROM refs GROUP BY 1")
def edges_callers(spark, sf):
    return slices.neighbours(from_star(spark, sf).refs(), "dst", "src")


@query(f"SELECT src AS node, count(DISTINCT dst) AS n_nodes, sum(n)::BIGINT AS n_sites, {_TIER} AS weakest FROM refs GROUP BY 1")
def edges_callees(spark, sf):
    return slices.neighbours(from_star(spark, sf).refs(), "src", "dst")


@query("SELECT dst AS region, count(*) AS n_importers, string_agg(src, ',' ORDER BY src) AS importers FROM edges WHERE kind = 'import' GROUP BY 1")
def imports_in(spark, sf):
    return from_star(spark, sf).edges.where("kind = 'import'").groupBy(F.col("dst").alias("region")).agg(F.count("*").alias("n_importers"), F.array_join(F.sort_array(F.collect_list("src")), ",").alias("importers"))


@query("SELECT src, dst, tier, rank::INT AS rank, n FROM refs")
def edge_provs(spark, sf):
    from skein.sources.graph import tier_rank

    return from_star(spark, sf).refs().select("src", "dst", "tier", tier_rank().alias("rank"), "n")


@query("SELECT * FROM (SELECT id, name, kind, file, CASE WHEN lower(name) = '42' THEN 'exact' WHEN ends_with(lower(name), '.42') OR ends_with(lower(name), ':42') THEN 'tail' WHEN contains(lower(name), '42') THEN 'substring' END AS match FROM nodes) WHERE match IS NOT NULL")
def node_find(spark, sf):
    return slices.find(from_star(spark, sf).nodes, "42")


@query("SELECT kind, file, count(*) AS n_nodes, count(entry) AS n_entries FROM nodes GROUP BY 1, 2")
def census_nodes(spark, sf):
    return from_star(spark, sf).nodes.groupBy("kind", "file").agg(F.count("*").alias("n_nodes"), F.count("entry").alias("n_entries"))


@query("SELECT kind, tier, count(*) AS n_edges, sum(n)::BIGINT AS n_sites FROM edges GROUP BY 1, 2")
def census_edges(spark, sf):
    return from_star(spark, sf).edges.groupBy("kind", "tier").agg(F.count("*").alias("n_edges"), F.sum("n").alias("n_sites"))


@query("SELECT CASE WHEN target IS NOT NULL THEN 'resolved' WHEN rule IS NOT NULL THEN 'refused' ELSE 'dynamic' END AS disposition, coalesce(rule, 'none') AS rule, count(*) AS n_calls, count(DISTINCT callee) AS n_callees FROM calls GROUP BY 1, 2")
def census_calls(spark, sf):
    return slices.census_calls(from_star(spark, sf).calls)


@query("SELECT CASE WHEN target IS NOT NULL THEN CASE WHEN tier = 'matched' THEN 'linked' ELSE coalesce(tier, 'linked') END WHEN rule IS NOT NULL THEN 'refused' ELSE 'frontier' END AS rung, count(*) AS n_calls FROM calls LEFT JOIN refs ON fn = src AND target = dst GROUP BY 1")
def ladder(spark, sf):
    return slices.ladder(from_star(spark, sf))


@query("SELECT tier, count(*) AS n_edges, sum(n)::BIGINT AS n_sites, min(rank)::INT AS rank FROM refs GROUP BY 1")
def ref_tier_histogram(spark, sf):
    from skein.sources.graph import tier_rank

    return from_star(spark, sf).refs().groupBy("tier").agg(F.count("*").alias("n_edges"), F.sum("n").alias("n_sites"), F.min(tier_rank()).alias("rank"))


@query("SELECT callee, CASE rule WHEN 'ambiguous' THEN 'internal_multi' WHEN 'blocked' THEN 'cross_scope' ELSE 'external' END AS bucket, count(*) AS n_calls, count(DISTINCT file) AS n_files FROM calls WHERE target IS NULL GROUP BY 1, 2")
def externals_surface(spark, sf):
    return slices.externals(from_star(spark, sf).calls)


@query("SELECT file, callee AS name, count(*) AS n_calls FROM calls WHERE target IS NULL GROUP BY 1, 2")
def requirement_set(spark, sf):
    return from_star(spark, sf).calls.where("target is null").groupBy("file", F.col("callee").alias("name")).agg(F.count("*").alias("n_calls"))


@query("""SELECT name, n_calls, CASE WHEN h AND NOT t THEN 'lost' WHEN NOT h AND t THEN 'gained' WHEN h AND t THEN 'kept' ELSE 'neither' END AS outcome FROM (
  SELECT callee AS name, count(*) AS n_calls, callee IN (SELECT callee FROM calls WHERE file = '1995' AND rule = 'blocked') AS h, callee IN (SELECT callee FROM calls WHERE file = '1996' AND rule = 'blocked') AS t FROM calls WHERE target IS NULL GROUP BY 1)""")
def portability_diff(spark, sf):
    calls = from_star(spark, sf).calls
    at = lambda year: calls.where((F.col("file") == year) & (F.col("rule") == "blocked")).select(F.col("callee").alias("name"))
    return diffs.move_diff(calls.where("target is null").groupBy(F.col("callee").alias("name")).agg(F.count("*").alias("n_calls")), at("1995"), at("1996"))


def _mentions(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("file"), "lang", F.explode(F.array_distinct(clones.words(F.col("text")))).alias("name"))


@query("SELECT word AS name, count(DISTINCT doc_id) AS n_files, min(doc_id) AS first, max(doc_id) AS last FROM words GROUP BY 1")
def mentions_postings(spark, sf):
    return clones.postings(_mentions(spark, sf).select("file", "name"))


@query("SELECT lang, word AS name, count(DISTINCT doc_id) AS n_files FROM words GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 1")
def mentioning_in_scope(spark, sf):
    # A document's words are distinct, so they are counted; only where ids repeat, files are told apart.
    ids = table(spark, sf, "documents").groupBy("doc_id").count()
    n = F.count("file") if ids.where("doc_id is not null and count > 1").isEmpty() else F.countDistinct("file")
    return _mentions(spark, sf).groupBy("lang", "name").agg(n.alias("n_files")).where("n_files > 1")


@query("SELECT callee, file, line, count(*) AS n_sites FROM calls GROUP BY 1, 2, 3")
def sites(spark, sf):
    return from_star(spark, sf).calls.groupBy("callee", "file", "line").agg(F.count("*").alias("n_sites"))


@query("""SELECT id, fanin, fanout, CASE WHEN fanin = 0 AND fanout = 0 THEN 'isolated' WHEN fanin = 0 THEN CASE WHEN exported THEN 'api' ELSE 'unused?' END WHEN fanin >= 4 AND fanin >= 2 * fanout THEN 'hub' WHEN fanout >= 4 AND fanout >= 2 * fanin THEN 'coordinator' WHEN fanout = 0 THEN 'leaf' ELSE '' END AS role
FROM (SELECT id, entry IS NOT NULL AS exported, coalesce(i.n, 0) AS fanin, coalesce(o.n, 0) AS fanout FROM nodes LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM refs GROUP BY 1) i ON id = dst LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM refs GROUP BY 1) o ON id = src)""")
def heat_roles(spark, sf):
    g = from_star(spark, sf)
    return slices.heat(g.nodes, g.refs())


@query("""SELECT dst AS var, count(*) FILTER (rw IN (1, 3)) AS n_reads, count(*) FILTER (rw IN (2, 3)) AS n_writes, CASE WHEN count(*) FILTER (rw IS NULL) > 0 THEN 'unclassified' WHEN count(*) FILTER (rw IN (2, 3)) = 0 THEN 'const' WHEN count(*) FILTER (rw IN (1, 3)) = 0 THEN 'dead' WHEN count(*) FILTER (rw IN (2, 3)) = 1 THEN 'single-writer' ELSE 'multi-writer' END AS label FROM edges WHERE kind = 'use' GROUP BY 1""")
def atlas_labels(spark, sf):
    return slices.atlas(from_star(spark, sf).edges.where("kind = 'use'"))


@query("""SELECT CASE WHEN ba > ab THEN b ELSE a END AS upper, CASE WHEN ba > ab THEN a ELSE b END AS lower, greatest(ab, ba) AS forward, least(ab, ba) AS backward, least(ab, ba) > 0 AND 4 * least(ab, ba) <= greatest(ab, ba) AS violation FROM (
  SELECT least(la, lb) AS a, greatest(la, lb) AS b, count(*) FILTER (la < lb) AS ab, count(*) FILTER (la > lb) AS ba FROM (SELECT x.n_regionkey AS la, y.n_regionkey AS lb FROM trade JOIN nation x ON src = x.n_nationkey JOIN nation y ON dst = y.n_nationkey) WHERE la <> lb GROUP BY 1, 2)""")
def layering_matrix(spark, sf):
    return slices.layering(trade(spark, sf), table(spark, sf, "nation").select(F.col("n_nationkey").cast("long"), "n_regionkey"))


@query("SELECT a AS root, b AS node FROM paths WHERE a <> b")
def cone_out(spark, sf):
    t = trade(spark, sf)
    return reach.cone(t, t.select(F.col("src").alias("root")).distinct()).select("root", "node")


@query("SELECT b AS root, a AS node FROM paths WHERE a <> b")
def cone_in(spark, sf):
    t = trade(spark, sf)
    return reach.cone(t, t.select(F.col("dst").alias("root")).distinct(), inward=True).select("root", "node")


_ENTRIES = "e AS (SELECT DISTINCT n_nationkey::BIGINT AS root FROM nation WHERE n_regionkey IN (0, 1)), t AS (SELECT node, count(*) AS n_entries, CASE WHEN count(*) = 1 THEN 'territory' WHEN count(*) = (SELECT count(*) FROM e) THEN 'core' ELSE 'commons' END AS class FROM (SELECT root, root AS node FROM e UNION SELECT a, b FROM paths JOIN e ON a = root) GROUP BY 1)"


def _territory(spark, sf) -> DataFrame:
    entries = table(spark, sf, "nation").where("n_regionkey in (0, 1)").select(F.col("n_nationkey").cast("long").alias("root")).distinct()
    return reach.territory(trade(spark, sf), entries)


@query(f", {_ENTRIES} SELECT * FROM t")
def territory(spark, sf):
    return _territory(spark, sf)


@query(f", {_ENTRIES} SELECT class, count(*) AS n_nodes, max(n_entries) AS most FROM t GROUP BY 1")
def territory_summary(spark, sf):
    return _territory(spark, sf).groupBy("class").agg(F.count("*").alias("n_nodes"), F.max("n_entries").alias("most"))


@query("SELECT node, component FROM scc")
def scc_components(spark, sf):
    return reach.components(trade(spark, sf))


@query(""", links AS (SELECT DISTINCT x.component AS a, y.component AS b FROM trade JOIN scc x ON src = x.node JOIN scc y ON dst = y.node WHERE x.component <> y.component),
walk AS (SELECT DISTINCT component AS a, component AS b, 0 AS d FROM scc UNION SELECT w.a, l.b, w.d + 1 FROM walk w JOIN links l ON w.b = l.a)
SELECT a AS component, max(d) AS level FROM walk GROUP BY 1""")
def scc_levels(spark, sf):
    return reach.levels(trade(spark, sf).select("src", "dst"))


@query("SELECT component, count(*) AS size FROM scc GROUP BY 1 HAVING count(*) > 1")
def call_cycles(spark, sf):
    return reach.components(trade(spark, sf)).groupBy("component").agg(F.count("*").alias("size")).where("size > 1")


@query("SELECT id, name, file FROM nodes WHERE kind = 'function' AND entry IS NULL AND id NOT IN (SELECT dst FROM refs)")
def dead_functions(spark, sf):
    g = from_star(spark, sf)
    return slices.unreferenced(g.nodes, g.refs())


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def lint_no_callees(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "anti").select(F.col("o_orderkey").alias("id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def lint_unlabelled(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "anti").select("doc_id")


@query(""", t AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS s FROM lineitem), s1 AS (SELECT s, count(*) AS solo FROM t GROUP BY 1)
SELECT x.s AS a, y.s AS b, count(*) AS together, count(*) / any_value(solo) AS confidence FROM t x JOIN t y ON x.c = y.c AND x.s < y.s JOIN s1 ON s1.s = x.s GROUP BY 1, 2 HAVING count(*) >= 2""")
def coupling_partners(spark, sf):
    return diffs.coupling(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("symbol")))


@query(""", g AS (SELECT year(l_shipdate) AS y, l_suppkey % 10 AS grp, l_suppkey AS symbol FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45 AND year(l_shipdate) IN (1995, 1996)),
s AS (SELECT grp, symbol, max((y = 1995)::INT) + 2 * max((y = 1996)::INT) AS s FROM g GROUP BY 1, 2), d AS (SELECT grp AS "group", count(*) FILTER (s = 2) AS added, count(*) FILTER (s = 1) AS removed, count(*) FILTER (s = 3) AS kept FROM s GROUP BY 1)
SELECT *, CASE WHEN added = 0 AND removed = 0 THEN 'internal' WHEN added = 1 AND removed = 1 THEN 'rename' WHEN added > 0 AND removed = 0 THEN 'extract' WHEN removed > 0 AND added = 0 THEN 'inline' ELSE 'restructure' END AS operation FROM d""")
def ledger_delta(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_returnflag = 'A' and l_quantity > 45").select(F.year("l_shipdate").alias("y"), (F.col("l_suppkey") % 10).alias("group"), F.col("l_suppkey").alias("symbol"))
    return diffs.ledger(rows.where("y = 1995"), rows.where("y = 1996"), "group")


_DIFF = """, g AS (SELECT year(l_shipdate) AS y, l_suppkey AS src, l_partkey AS dst, l_linenumber AS sig FROM lineitem),
b AS (SELECT src, dst, list_sort(list(sig)) AS s FROM g WHERE y = 1995 GROUP BY 1, 2), a AS (SELECT src, dst, list_sort(list(sig)) AS s FROM g WHERE y = 1996 GROUP BY 1, 2),
d AS (SELECT coalesce(b.src, a.src) AS src, coalesce(b.dst, a.dst) AS dst, CASE WHEN b.s IS NULL THEN 'added' WHEN a.s IS NULL THEN 'removed' WHEN a.s <> b.s THEN 'changed' END AS change FROM b FULL JOIN a ON a.src = b.src AND a.dst = b.dst)"""


def _graphdiff(spark, sf) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("y"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("sig"))
    return diffs.edge_diff(rows.where("y = 1995"), rows.where("y = 1996"), ["src", "dst"], "sig")


@query(_DIFF + " SELECT * FROM d WHERE change IS NOT NULL")
def graphdiff(spark, sf):
    return _graphdiff(spark, sf)


@query(_DIFF + " SELECT change, count(*) AS n FROM d WHERE change IS NOT NULL GROUP BY 1")
def graphdiff_by_kind(spark, sf):
    return _graphdiff(spark, sf).groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS hash, count(*) AS size, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def clones_exact(spark, sf):
    return clones.exact(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body")))


@query(""", l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, sha256(array_to_string(lines[i:i + 2], chr(10))) AS run FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l WHERE len(lines) >= 3))
SELECT run, count(*) AS n_places, count(DISTINCT doc_id) AS n_bodies, min(doc_id) AS first FROM r GROUP BY 1 HAVING count(DISTINCT doc_id) > 1""")
def clones_blocks(spark, sf):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return clones.blocks(table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("id"), lines.alias("lines")))


@query(""", k AS (SELECT DISTINCT doc_id AS id, trim(unnest(string_split(text, chr(10))), ' ') AS key FROM documents), rare AS (SELECT key FROM k WHERE key <> '' GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30)
SELECT x.id AS a, y.id AS b, count(*) AS shared FROM k x JOIN rare USING (key) JOIN k y ON x.key = y.key AND x.id < y.id GROUP BY 1, 2 HAVING count(*) >= 2""")
def clones_near(spark, sf):
    return clones.near(_line_keys(spark, sf))


_LINES = ", k AS (SELECT DISTINCT id, key FROM (SELECT doc_id AS id, trim(unnest(string_split(text, chr(10))), ' ') AS key FROM documents) WHERE key <> ''), kn AS (SELECT id, key, n FROM k JOIN (SELECT key, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1) USING (key))"


def _line_keys(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("key")).select("id", F.trim("key").alias("key")).where("key <> ''")


@query(_LINES + """, blind AS (SELECT id FROM kn GROUP BY 1 HAVING min(n) > 30), r AS (SELECT id, key FROM kn WHERE n <= 30 OR (n <= 64 AND key IN (SELECT key FROM kn JOIN blind USING (id) WHERE n <= 64)))
SELECT x.id AS a, y.id AS b, count(*) AS shared FROM r x JOIN r y ON x.key = y.key AND x.id < y.id GROUP BY 1, 2 HAVING count(*) >= 2 OR x.id IN (SELECT id FROM blind) OR y.id IN (SELECT id FROM blind)""")
def clones_near_rescued(spark, sf):
    return clones.near_rescued(_line_keys(spark, sf))


@query(_LINES + ", s AS (SELECT id, list_sort(list(key)) AS keys FROM kn WHERE n > 30 GROUP BY 1), c AS (SELECT keys, min(id) AS class, count(*) AS size FROM s GROUP BY 1 HAVING count(*) > 1) SELECT id, class, size, len(keys)::BIGINT AS n_keys FROM s JOIN c USING (keys)")
def clones_near_classes(spark, sf):
    return clones.common_classes(_line_keys(spark, sf))


_KEYS = ", k AS (SELECT user_id || ':' || (props->>'k') AS key, event_type FROM events)"


def _events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.get_json_object("props", "$.k")).alias("key"), "event_type")


@query(_KEYS + """, a AS (SELECT key, count(*) AS n_acquired FROM k WHERE event_type = 'signup' GROUP BY 1), r AS (SELECT key, count(*) AS n_released FROM k WHERE event_type = 'purchase' GROUP BY 1)
SELECT key, coalesce(n_acquired, 0) AS n_acquired, coalesce(n_released, 0) AS n_released, CASE WHEN n_released IS NULL THEN 'acquired-not-released' WHEN n_acquired IS NULL THEN 'released-not-acquired' ELSE 'paired' END AS finding FROM a FULL JOIN r USING (key)""")
def pair_audit(spark, sf):
    e = _events(spark, sf)
    return diffs.pair_audit(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"))


@query(_KEYS + " SELECT key, count(*) FILTER (event_type = 'signup') AS n_registered, count(*) FILTER (event_type = 'click') AS n_dispatched FROM k WHERE event_type IN ('signup', 'click') GROUP BY 1 HAVING (count(*) FILTER (event_type = 'signup') = 0) <> (count(*) FILTER (event_type = 'click') = 0)")
def registry_audit(spark, sf):
    n = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    out = _events(spark, sf).where("event_type in ('signup', 'click')").groupBy("key").agg(n("signup").alias("n_registered"), n("click").alias("n_dispatched"))
    return out.where("(n_registered = 0) <> (n_dispatched = 0)")


@query("SELECT c_custkey, count(s_suppkey) AS n_found, CASE WHEN count(s_suppkey) = 1 THEN 'linked' WHEN count(s_suppkey) > 1 THEN 'ambiguous' ELSE 'missing' END AS outcome FROM customer LEFT JOIN supplier ON lower(s_name) = replace(lower(c_name), 'customer', 'supplier') GROUP BY 1")
def dblink_match(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    j = c.join(s, F.lower("s_name") == F.replace(F.lower("c_name"), F.lit("customer"), F.lit("supplier")), "left").groupBy("c_custkey").agg(F.count("s_suppkey").alias("n_found"))
    return j.withColumn("outcome", F.when(F.col("n_found") == 1, "linked").when(F.col("n_found") > 1, "ambiguous").otherwise("missing"))


_FSM = ", f AS (SELECT source, target, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS source, event_type AS target FROM events) WHERE source IS NOT NULL GROUP BY 1, 2)"


@query(_FSM + " SELECT * FROM f")
def fsm_transitions(spark, sf):
    return diffs.transitions(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(_FSM + ", p AS (SELECT source AS root, target AS node FROM f WHERE n > 2 UNION SELECT p.root, f.target FROM p JOIN f ON p.node = f.source AND f.n > 2) SELECT * FROM p WHERE root <> node")
def fsm_state_cone(spark, sf):
    f = diffs.transitions(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type").where("n > 2").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return reach.cone(f, f.select(F.col("src").alias("root")).distinct()).select("root", "node")


@query("SELECT l_returnflag, count(*) AS n, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.9) AS p90, quantile_disc(l_quantity, 0.99) AS p99 FROM lineitem GROUP BY 1")
def percentile_summary(spark, sf):
    return slices.percentiles(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


@query("SELECT a AS c0, b AS c1 FROM paths")
def saturate_paths(spark, sf):
    rules = [Rule(("path", ("x", "y")), (("edge", ("x", "y")),)), Rule(("path", ("x", "z")), (("path", ("x", "y")), ("edge", ("y", "z"))))]
    return saturate({"edge": trade(spark, sf).select(F.col("src").alias("c0"), F.col("dst").alias("c1"))}, rules)["path"]


@query(", k AS (SELECT l_orderkey AS key, count(*) AS nl FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS key, count(*) AS nr FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), j AS (SELECT nl, coalesce(nr, 0) AS nr FROM k LEFT JOIN o USING (key)) SELECT sum(nl)::BIGINT AS n_left, sum(CASE WHEN nr > 0 THEN nl ELSE 0 END)::BIGINT AS n_linked, sum(CASE WHEN nr = 0 THEN nl ELSE 0 END)::BIGINT AS n_dangling, count(*) FILTER (nl > 1 AND nr > 1) AS n_ambiguous, max(nr) AS max_fan, max(nr) <= 1 AS is_function, 0::BIGINT AS n_unreadable FROM j")
def link_relational(spark, sf):
    return diffs.link(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")), table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key")))


@query("SELECT 'node-without-id' AS problem, count(*) FILTER (id IS NULL OR name IS NULL OR file IS NULL) AS n FROM nodes UNION ALL SELECT 'node-kind', count(*) FILTER (kind NOT IN ('module', 'function', 'var')) FROM nodes UNION ALL SELECT 'edge-kind', count(*) FILTER (kind NOT IN ('ref', 'import', 'use', 'reg')) FROM edges UNION ALL SELECT 'edge-source', count(*) FILTER (src NOT IN (SELECT id FROM nodes)) FROM edges UNION ALL SELECT 'edge-target', count(*) FILTER (dst NOT IN (SELECT id FROM nodes)) FROM edges")
def validate_graph(spark, sf):
    return invalid(from_star(spark, sf))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_windows(spark, sf):
    return windowed(table(spark, sf, "events")).select("start", "event_type", "n")


@query("SELECT dst, sum(n)::BIGINT AS rewrites, count(DISTINCT CASE WHEN tier <> 'inferred' THEN src END) AS requires FROM refs GROUP BY 1")
def impact(spark, sf):
    better = F.countDistinct(F.when(F.col("tier") != "inferred", F.col("src")))
    return from_star(spark, sf).refs().groupBy("dst").agg(F.sum("n").alias("rewrites"), better.alias("requires"))


@query(", o AS (SELECT DISTINCT fn, callee, 's' || (substr(callee, 2)::BIGINT + line % 2) AS target FROM calls), m AS (SELECT fn, callee, count(*) AS n FROM o GROUP BY 1, 2), c AS (SELECT DISTINCT fn, callee, target FROM calls) SELECT c.fn, c.callee, CASE WHEN c.target IS NULL THEN 'recovered' WHEN o.target IS NOT NULL THEN 'confirmed' WHEN n = 1 THEN 'conflict' ELSE 'polymorphic' END AS verdict FROM c JOIN m ON c.fn = m.fn AND c.callee = m.callee LEFT JOIN o ON o.fn = c.fn AND o.callee = c.callee AND o.target = c.target")
def confirm_diff(spark, sf):
    calls = from_star(spark, sf).calls
    seen = calls.select("fn", "callee", F.concat(F.lit("s"), (F.substring("callee", 2, 20).cast("long") + F.col("line") % 2).cast("string")).alias("target"))
    return diffs.confirm(calls, seen)


@query("SELECT a.n_name AS name, b.n_name AS near, damerau_levenshtein(a.n_name, b.n_name)::INT AS distance FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey WHERE damerau_levenshtein(a.n_name, b.n_name) <= CASE WHEN length(a.n_name) >= 5 THEN 2 ELSE 1 END")
def near_names(spark, sf):
    return near_pairs(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
