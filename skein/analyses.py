"""Program analyses, scopes, registries and key audits by name, with DuckDB SQL for each; the graph's slices are in catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.catalog import PRELUDE
from skein.operators import diffs, flow, reach, registries, scopes
from skein.sources.graph import from_star, table, trade

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, PRELUDE + sql
        return f

    return add


_VS = ", vs AS (SELECT src AS v FROM trade UNION SELECT dst FROM trade)"


def _vertices(spark, sf) -> DataFrame:
    t = trade(spark, sf)
    return t.select(F.col("src").alias("v")).union(t.select("dst")).distinct()


# Orders as ranges of days in their customer's file.
_RANGES = ", ranges AS (SELECT o_orderkey AS id, o_custkey AS file, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS sl, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + o_orderkey % 97 AS el FROM orders)"


def _ranges(spark, sf) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file"), day.alias("sl"), (day + F.col("o_orderkey") % 97).alias("el"))


@query(_RANGES + """, p AS (SELECT DISTINCT file, sl + 5 AS line FROM ranges)
SELECT file, line, id, n_enclosing FROM (SELECT p.file, p.line, r.id, count(*) OVER (PARTITION BY p.file, p.line) AS n_enclosing, row_number() OVER (PARTITION BY p.file, p.line ORDER BY el - sl, sl DESC, id) AS k FROM p JOIN ranges r ON r.file = p.file AND p.line BETWEEN sl AND el) WHERE k = 1""")
def node_at(spark, sf):
    r = _ranges(spark, sf)
    return scopes.node_at(r.select("file", (F.col("sl") + 5).alias("line")), r)


@query(_RANGES + ", p AS (SELECT DISTINCT file, sl + 5 AS line FROM ranges) SELECT r.id, count(*) AS n_lines, min(p.line) AS first FROM p JOIN ranges r ON r.file = p.file AND p.line BETWEEN sl AND el GROUP BY 1")
def line_attribution(spark, sf):
    r = _ranges(spark, sf)
    changed = r.select("file", (F.col("sl") + 5).alias("line")).distinct()
    return scopes.containing(changed, r).groupBy("id").agg(F.count("*").alias("n_lines"), F.min("line").alias("first"))


@query("SELECT event_id, last FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM events) WHERE event_type = 'click'")
def last_def_before_use(spark, sf):
    e = table(spark, sf, "events").where("event_type in ('view', 'click')")
    found = scopes.last_before(e, "user_id", F.date_trunc("month", "ts"), ["ts", "event_id"], F.when(F.col("event_type") == "view", F.col("event_id")))
    return found.where("event_type = 'click'").select("event_id", "last")


@query(""", i AS (SELECT dst, count(*) AS n_in, count(*) FILTER (n % 2 = 1) AS n_value FROM trade GROUP BY 1), u AS (SELECT DISTINCT dst FROM trade WHERE src <> dst AND n % 3 = 0)
SELECT n_nationkey::BIGINT AS file, CASE WHEN n_in IS NULL AND n_regionkey = 2 THEN 'entry' WHEN u.dst IS NOT NULL THEN 'used' WHEN n_in IS NULL THEN 'orphan' WHEN n_value > 0 THEN 'value' WHEN n_nationkey % 2 = 1 THEN 'sideeffect' ELSE 'deadimport' END AS role FROM nation LEFT JOIN i ON i.dst = n_nationkey LEFT JOIN u ON u.dst = n_nationkey""")
def file_roles(spark, sf):
    t = trade(spark, sf)
    files = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("file"), (F.col("n_regionkey") == 2).alias("entry"), (F.col("n_nationkey") % 2 == 1).alias("effects"))
    return scopes.file_roles(files, t.select("src", "dst", (F.col("n") % 2 == 0).alias("sideeffect")), t.where("n % 3 = 0"))


@query(""", c AS (SELECT fn, file, CASE k % 4 WHEN 0 THEN 'self' WHEN 1 THEN 'p' || k % 10 WHEN 2 THEN 'q' || k % 10 END AS recv FROM (SELECT *, substr(callee, 2)::BIGINT AS k FROM calls WHERE target IS NULL AND rule = 'ambiguous')),
t AS (SELECT file, recv, CASE WHEN recv = 'self' THEN 'self' WHEN recv[1] = 'p' AND substr(recv, 2)::BIGINT % 3 = file::BIGINT % 3 THEN 'alias' WHEN recv[1] = 'q' AND substr(recv, 2)::BIGINT = substr(fn, 2)::BIGINT % 10 THEN 'local' ELSE 'unknown' END AS class FROM c WHERE recv IS NOT NULL)
SELECT file, recv, class, count(*) AS n_calls, count(*) * CASE class WHEN 'alias' THEN 4 WHEN 'self' THEN 3 WHEN 'local' THEN 2 ELSE 1 END AS score FROM t GROUP BY 1, 2, 3""")
def narrowable_refusals(spark, sf):
    calls = from_star(spark, sf).calls
    k = F.substring("callee", 2, 20).cast("long")
    form = F.when(k % 4 == 0, "self.go").when(k % 4 == 1, F.concat(F.lit("p"), (k % 10).cast("string"), F.lit(".go"))).when(k % 4 == 2, F.concat(F.lit("q"), (k % 10).cast("string"), F.lit(":go"))).otherwise("go")
    open_ = calls.where("target is null and rule = 'ambiguous'").select("fn", "file", form.alias("name"))
    years = calls.select("file").distinct().withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(9)))).where("d % 3 = cast(file as long) % 3")
    locals_ = calls.select("fn").distinct().select("fn", F.concat(F.lit("q"), (F.substring("fn", 2, 20).cast("long") % 10).cast("string")).alias("name"))
    return scopes.narrowable(open_, years.select("file", F.concat(F.lit("p"), F.col("d").cast("string")).alias("name")), locals_)


@query(""", p AS (SELECT DISTINCT file AS band, callee AS name FROM calls WHERE target IS NULL), x AS (SELECT s_nationkey AS peer, 's' || s_suppkey % 70 AS name FROM supplier), s AS (SELECT y AS band, n_nationkey AS peer FROM (SELECT DISTINCT file AS y FROM calls) JOIN nation ON n_nationkey % 4 = y::BIGINT % 4),
h AS (SELECT band, name, count(*) AS n FROM s JOIN (SELECT DISTINCT * FROM x) USING (peer) GROUP BY 1, 2)
SELECT band, name, coalesce(n, 0) AS n_hits, CASE WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS outcome FROM p LEFT JOIN h USING (band, name)""")
def band_links(spark, sf):
    calls = from_star(spark, sf).calls
    exports = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("peer"), F.concat(F.lit("s"), (F.col("s_suppkey") % 70).cast("string")).alias("name"))
    shares = calls.select(F.col("file").alias("band")).distinct().withColumn("_k", F.col("band").cast("long") % 4).join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("peer"), (F.col("n_nationkey") % 4).cast("long").alias("_k")), "_k").select("band", "peer")
    return scopes.link_bands(calls.where("target is null").select(F.col("file").alias("band"), F.col("callee").alias("name")), exports, shares)


@query("""SELECT s_suppkey AS id, concat_ws(',', CASE WHEN file = dest THEN 'noop' END, CASE WHEN file % 4 = 0 OR dest % 4 = 0 THEN 'load-order' END, CASE WHEN EXISTS (SELECT 1 FROM trade WHERE src = s_suppkey % 25 AND dst = m.dest) THEN 'cycle' END) AS hazards
FROM (SELECT s_suppkey, s_nationkey::BIGINT AS file, s_suppkey * 3 % 25 AS dest FROM supplier) m""")
def move_hazards(spark, sf):
    s = table(spark, sf, "supplier")
    moves = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("file"), (F.col("s_suppkey") * 3 % 25).alias("dest"))
    acts = table(spark, sf, "nation").where("n_nationkey % 4 = 0").select(F.col("n_nationkey").cast("long").alias("file"))
    return scopes.move_hazards(moves, s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 25).alias("need")), trade(spark, sf), acts)


_OWN = _VS + ", own AS (SELECT v AS fn, 'write' AS kind, 'v' || v % 3 AS key, 1 + v % 3 AS tier FROM vs WHERE v % 4 = 1 UNION ALL SELECT v, 'io', 'io', 1 FROM vs WHERE v % 7 = 3 UNION ALL SELECT v, 'hedge', 'hedge', 1 FROM vs WHERE v % 6 = 5), ef AS (SELECT fn, kind, key, min(tier) AS tier FROM (SELECT fn, kind, key, tier FROM own UNION ALL SELECT a, kind, key, tier FROM paths JOIN own ON b = fn) GROUP BY 1, 2, 3)"


def _effects(spark, sf) -> DataFrame:
    v, c = _vertices(spark, sf), F.col("v")
    row = lambda where, kind, key, tier: v.where(where).select(c.alias("fn"), F.lit(kind).alias("kind"), key.alias("key"), tier.alias("tier"))
    one = F.lit(1).cast("long")
    own = row("v % 4 = 1", "write", F.concat(F.lit("v"), (c % 3).cast("string")), 1 + c % 3).union(row("v % 7 = 3", "io", F.lit("io"), one)).union(row("v % 6 = 5", "hedge", F.lit("hedge"), one))
    return flow.effects(trade(spark, sf), own)


@query(_OWN + " SELECT * FROM ef")
def effects_summary(spark, sf):
    return _effects(spark, sf)


@query(_OWN + " SELECT v AS fn, CASE WHEN bool_or(kind = 'write') THEN 'writes' WHEN bool_or(kind = 'io') THEN 'io' ELSE 'pure' END || CASE WHEN bool_or(kind = 'hedge') THEN '~' ELSE '' END AS label FROM vs LEFT JOIN ef ON fn = v GROUP BY 1")
def purity_labels(spark, sf):
    return flow.purity(_vertices(spark, sf).toDF("fn"), _effects(spark, sf))


@query(_VS + ", lv AS (SELECT v AS node, (v * 2 + 1) % 5 AS var FROM vs UNION SELECT t.src, lv.var FROM lv JOIN trade t ON t.dst = lv.node WHERE t.src % 5 <> lv.var) SELECT node, var FROM lv")
def liveness(spark, sf):
    v, c = _vertices(spark, sf), F.col("v")
    return flow.live(trade(spark, sf), v.select(c.alias("node"), ((c * 2 + 1) % 5).alias("var")), v.select(c.alias("node"), (c % 5).alias("var")))


@query(", rd AS (SELECT dst AS node, src AS def FROM trade UNION SELECT t.dst, rd.def FROM rd JOIN trade t ON t.src = rd.node WHERE rd.node % 5 <> rd.def % 5) SELECT node, def % 5 AS var, def FROM rd")
def reaching_definitions(spark, sf):
    return flow.reaching(trade(spark, sf), _vertices(spark, sf).select(F.col("v").alias("node"), (F.col("v") % 5).alias("var")))


@query(", tn AS (SELECT src AS source, dst AS node FROM trade WHERE src % 3 = 0 AND dst % 7 <> 4 UNION SELECT source, dst FROM tn JOIN trade ON src = node WHERE dst % 7 <> 4) SELECT source, node AS sink FROM tn WHERE node % 5 IN (2, 3)")
def taint_reach(spark, sf):
    v = _vertices(spark, sf).toDF("node")
    return flow.tainted(trade(spark, sf), v.where("node % 3 = 0"), v.where("node % 5 in (2, 3)"), v.where("node % 7 = 4"))


@query(_VS + ", lc AS (SELECT v AS fn, v % 3 AS depth FROM vs UNION SELECT t.src, lc.depth + t.n % 2 FROM lc JOIN trade t ON t.dst = lc.fn WHERE t.src > t.dst) SELECT fn, max(depth) AS depth FROM lc GROUP BY 1")
def loop_cost(spark, sf):
    nodes = _vertices(spark, sf).select(F.col("v").alias("fn"), (F.col("v") % 3).alias("own"))
    return flow.loop_depth(nodes, trade(spark, sf).where("src > dst").select("src", "dst", (F.col("n") % 2).alias("loops")))


_DOMINATORS = _VS + """, rc AS (SELECT v AS root, v AS node FROM vs UNION SELECT a, b FROM paths),
av AS (SELECT root, node AS gone, root AS node FROM rc WHERE node <> root UNION SELECT av.root, av.gone, t.dst FROM av JOIN trade t ON t.src = av.node WHERE t.dst <> av.gone),
dm AS (SELECT r.root, g.node AS d, r.node FROM rc r JOIN rc g ON r.root = g.root AND g.node <> r.node WHERE r.node <> r.root AND (g.node = r.root OR NOT EXISTS (SELECT 1 FROM av WHERE av.root = r.root AND av.gone = g.node AND av.node = r.node))),
dd AS (SELECT root, node, count(*) AS depth FROM dm GROUP BY 1, 2),
tree AS (SELECT dm.root, dm.node, arg_max(dm.d, coalesce(u.depth, 0)) AS idom, any_value(dd.depth) AS depth FROM dm JOIN dd ON dd.root = dm.root AND dd.node = dm.node LEFT JOIN dd u ON u.root = dm.root AND u.node = dm.d GROUP BY 1, 2)"""


def _dominators(spark, sf) -> DataFrame:
    return flow.dominators(trade(spark, sf), _vertices(spark, sf).toDF("root"))


@query(_DOMINATORS + " SELECT root, node, idom, depth FROM tree")
def dominators(spark, sf):
    return _dominators(spark, sf)


@query(_DOMINATORS + ", s AS (SELECT root, count(*) + 1 AS n, max(depth) AS depth, count(*) FILTER (depth = 1) AS children FROM tree GROUP BY 1) SELECT *, CASE WHEN n <= 2 THEN 'trivial' WHEN 2 * children >= n - 1 THEN 'bushy' WHEN depth >= 4 THEN 'spine' ELSE 'shallow' END AS shape FROM s")
def spine_shapes(spark, sf):
    return flow.shapes(_dominators(spark, sf))


# Events as call sites: the verb is the type and user, the key a number that a third of the verbs spell as one.
_SITES = ", st AS (SELECT event_type || user_id AS verb, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'k' END || (props->>'k') AS key, coalesce(value > 20, false) AS callable FROM events)"


def _sites(spark, sf) -> DataFrame:
    key = F.concat(F.when(F.col("user_id") % 3 == 0, "").otherwise("k"), F.get_json_object("props", "$.k"))
    return table(spark, sf, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("verb"), key.alias("key"), F.coalesce(F.col("value") > 20, F.lit(False)).alias("callable"))


@query(_SITES + ", g AS (SELECT verb, count(*) AS n_sites, count(*) FILTER (callable) AS n_callable, count(DISTINCT key) AS n_keys, count(DISTINCT key) FILTER (key[1] = 'k') AS n_names FROM st GROUP BY 1) SELECT * FROM g WHERE n_sites >= 2 AND n_callable >= 2 AND 2 * n_callable >= n_sites AND n_keys >= 2 AND 10 * n_names >= 6 * n_keys")
def registry_discovery(spark, sf):
    return registries.registries(_sites(spark, sf))


@query(_SITES + ", g AS (SELECT regexp_extract(verb, '^[a-z]+') || length(verb) AS verb, count(*) AS n_sites, count(DISTINCT key) AS n_keys, count(DISTINCT key) FILTER (key[1] = 'k') AS n_paths FROM st WHERE key[1] = 'k' OR verb[1] <> 'v' GROUP BY 1) SELECT * FROM g WHERE n_sites >= 30 AND n_keys >= 10 AND 10 * n_paths >= 8 * n_keys")
def factories(spark, sf):
    s = _sites(spark, sf).where("substring(key, 1, 1) = 'k' or substring(verb, 1, 1) <> 'v'")
    return registries.factories(s.select(F.concat(F.regexp_extract("verb", "^[a-z]+", 0), F.length("verb").cast("string")).alias("verb"), "key"))


_MIRRORS = """, k AS (SELECT DISTINCT doc_id AS id, trim(unnest(string_split(text, chr(10))), ' ') AS member FROM documents), tl AS (SELECT * FROM k WHERE member <> '' AND member IN (SELECT member FROM k GROUP BY 1 HAVING count(*) <= 25)), z AS (SELECT id, count(*) AS size FROM tl GROUP BY 1),
mr AS (SELECT a, b, shared FROM (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM tl x JOIN tl y ON x.member = y.member AND x.id < y.id GROUP BY 1, 2 HAVING count(*) >= 4) JOIN z p ON p.id = a JOIN z q ON q.id = b WHERE 10 * shared >= 6 * least(p.size, q.size) AND NOT (shared = p.size AND shared = q.size))"""


def _mirrors(spark, sf) -> DataFrame:
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("member")).select("id", F.trim("member").alias("member"))
    return registries.mirrors(lines.where("member <> ''"))


@query(_MIRRORS + " SELECT * FROM mr")
def schema_mirrors(spark, sf):
    return _mirrors(spark, sf)


@query(_MIRRORS + ", ln AS (SELECT a, b FROM mr UNION SELECT b, a FROM mr), fm AS (SELECT a, b FROM ln UNION SELECT fm.a, ln.b FROM fm JOIN ln ON fm.b = ln.a) SELECT a AS node, least(a, min(b)) AS family FROM fm GROUP BY a")
def mirror_families(spark, sf):
    return registries.connected(_mirrors(spark, sf))


@query(", f AS (SELECT DISTINCT source, target FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS source, event_type AS target FROM events) WHERE source IS NOT NULL), lb AS (SELECT source AS state, unnest(['onbeforego_' || target, 'ongo_' || target, 'onaftergo_' || target, 'onleave' || source, 'onenter' || target, 'on' || target, 'onstatechange']) AS label FROM f) SELECT DISTINCT * FROM lb")
def fsm_callbacks(spark, sf):
    f = diffs.transitions(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")
    return registries.callbacks(f.select(F.concat(F.lit("go_"), F.col("target")).alias("name"), "source", "target"))


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def primary_key_test(spark, sf):
    return scopes.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT 'orders' AS relation, count(*) AS n_dangling FROM orders WHERE o_custkey % 10 = 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)")
def cascade_delete(spark, sf):
    gone = table(spark, sf, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf, "orders").join(gone, "o_custkey", "semi").select(F.col("o_orderkey").alias("l_orderkey"))
    count = lambda df, name: df.agg(F.count("*").alias("n_dangling")).select(F.lit(name).alias("relation"), "n_dangling")
    return count(orders, "orders").union(count(table(spark, sf, "lineitem").join(orders, "l_orderkey", "semi"), "lineitem"))


@query("SELECT dst AS node, count(DISTINCT src) AS n_callers, any_value(substr(dst, 2)::BIGINT % 6) AS n_rows FROM refs WHERE dst[1] = 's' AND substr(dst, 2)::BIGINT % 6 <= 2 GROUP BY 1 HAVING count(DISTINCT src) >= 15")
def lint_access_point(spark, sf):
    refs = from_star(spark, sf).refs().where("dst like 's%'")
    rows = F.substring("dst", 2, 20).cast("long") % 6
    return refs.where(rows <= 2).groupBy(F.col("dst").alias("node"), rows.alias("n_rows")).agg(F.countDistinct("src").alias("n_callers")).where("n_callers >= 15")


@query("SELECT root, min(node) AS first, count(*) AS n_nodes, max(depth) AS furthest FROM (SELECT a AS root, b AS node, least(min(d), 99) AS depth FROM (WITH RECURSIVE w AS (SELECT src AS a, dst AS b, 1 AS d FROM trade UNION SELECT w.a, t.dst, w.d + 1 FROM w JOIN trade t ON t.src = w.b WHERE w.d < 25) SELECT * FROM w) WHERE a <> b GROUP BY 1, 2) GROUP BY 1")
def cone_summary(spark, sf):
    t = trade(spark, sf)
    return reach.cone(t, t.select(F.col("src").alias("root")).distinct()).groupBy("root").agg(F.min("node").alias("first"), F.count("*").alias("n_nodes"), F.max("depth").alias("furthest"))
