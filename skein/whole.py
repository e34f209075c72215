"""Closure, components, levels, rules and data flow over all edges of the graph; catalog and analyses run them on the small trade graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.catalog import PRELUDE
from skein.operators import flow, reach, slices
from skein.plans.rules import Rule, saturate
from skein.sources.graph import from_star, links

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_EDGES = ", we AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), wp AS (SELECT src AS a, dst AS b FROM we UNION SELECT wp.a, we.dst FROM wp JOIN we ON wp.b = we.src)"
_SCC = _EDGES + ", wc AS (SELECT p.a, min(p.b) AS b FROM wp p JOIN wp q ON p.a = q.b AND p.b = q.a GROUP BY 1), ws AS (SELECT v AS node, least(v, coalesce(b, v)) AS component FROM (SELECT src AS v FROM we UNION SELECT dst FROM we) LEFT JOIN wc ON a = v)"
_WRITES, _READS = "kind = 'use' AND rw IN (2, 3)", "kind = 'use' AND rw IN (1, 3)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, PRELUDE + sql
        return f

    return add


def _edges(spark, sf) -> DataFrame:
    return links(spark, sf)


def _uses(spark, sf, where: str) -> DataFrame:
    return from_star(spark, sf).edges.where(where)


def _refs(spark, sf) -> DataFrame:
    return from_star(spark, sf).refs().select("src", "dst")


@query(_EDGES + " SELECT a AS root, b AS node FROM wp WHERE a <> b")
def cone_out_graph(spark, sf):
    e = _edges(spark, sf)
    return reach.cone(e, e.select(F.col("src").alias("root")).distinct()).select("root", "node")


@query(_EDGES + " SELECT b AS root, a AS node FROM wp WHERE a <> b")
def cone_in_graph(spark, sf):
    e = _edges(spark, sf)
    return reach.cone(e, e.select(F.col("dst").alias("root")).distinct(), inward=True).select("root", "node")


@query(_EDGES + ", en AS (SELECT id AS root FROM nodes WHERE entry IS NOT NULL) SELECT node, count(*) AS n_entries, CASE WHEN count(*) = 1 THEN 'territory' WHEN count(*) = (SELECT count(*) FROM en) THEN 'core' ELSE 'commons' END AS class FROM (SELECT root, root AS node FROM en UNION SELECT a, b FROM wp JOIN en ON a = root) GROUP BY 1")
def territory_graph(spark, sf):
    return reach.territory(_edges(spark, sf), from_star(spark, sf).nodes.where("entry is not null").select(F.col("id").alias("root")))


@query(_SCC + " SELECT node, component FROM ws")
def scc_components_graph(spark, sf):
    return reach.components(_edges(spark, sf))


# The graph has no cycles, as its SQL may assume; the operator doesn't.
@query(_EDGES + ", wl AS (SELECT v AS component, 0 AS level FROM (SELECT src AS v FROM we UNION SELECT dst FROM we) UNION SELECT src, level + 1 FROM wl JOIN we ON dst = component) SELECT component, max(level) AS level FROM wl GROUP BY 1")
def scc_levels_graph(spark, sf):
    return reach.levels(_edges(spark, sf))


@query(_SCC + " SELECT component, count(*) AS size FROM ws GROUP BY 1 HAVING count(*) > 1")
def call_cycles_graph(spark, sf):
    return reach.components(_edges(spark, sf)).groupBy("component").agg(F.count("*").alias("size")).where("size > 1")


@query(_EDGES + " SELECT a AS c0, b AS c1 FROM wp")
def saturate_paths_graph(spark, sf):
    rules = [Rule(("path", ("x", "y")), (("edge", ("x", "y")),)), Rule(("path", ("x", "z")), (("path", ("x", "y")), ("edge", ("y", "z"))))]
    return saturate({"edge": _edges(spark, sf).toDF("c0", "c1")}, rules)["path"]


@query(f", lv AS (SELECT src AS node, dst AS var FROM edges WHERE {_READS} UNION SELECT r.src, var FROM lv JOIN refs r ON r.dst = node WHERE NOT EXISTS (SELECT 1 FROM edges d WHERE d.{_WRITES} AND d.src = r.src AND d.dst = var)) SELECT node, var FROM lv")
def liveness_graph(spark, sf):
    of = lambda where: _uses(spark, sf, where).select(F.col("src").alias("node"), F.col("dst").alias("var")).distinct()
    return flow.live(_refs(spark, sf), of(_READS), of(_WRITES))


@query(f", df AS (SELECT DISTINCT src AS node, dst AS var FROM edges WHERE {_WRITES}), rd AS (SELECT r.dst AS node, var, df.node AS def FROM df JOIN refs r ON r.src = df.node UNION SELECT r.dst, var, def FROM rd JOIN refs r ON r.src = node WHERE NOT EXISTS (SELECT 1 FROM df WHERE df.node = rd.node AND df.var = rd.var)) SELECT node, var, def FROM rd")
def reaching_definitions_graph(spark, sf):
    return flow.reaching(_refs(spark, sf), _uses(spark, sf, _WRITES).select(F.col("src").alias("node"), F.col("dst").alias("var")).distinct())


# From entries to variables, where functions that write nothing let nothing through.
@query(f", sn AS (SELECT id FROM nodes WHERE kind = 'function' AND id NOT IN (SELECT src FROM edges WHERE {_WRITES})), tn AS (SELECT src AS source, dst AS node FROM refs JOIN nodes ON src = id WHERE entry IS NOT NULL AND dst NOT IN (SELECT id FROM sn) UNION SELECT source, dst FROM tn JOIN refs ON src = node WHERE dst NOT IN (SELECT id FROM sn)) SELECT source, node AS sink FROM tn JOIN nodes ON id = node WHERE kind = 'var'")
def taint_reach_graph(spark, sf):
    nodes = from_star(spark, sf).nodes
    of = lambda where: nodes.where(where).select(F.col("id").alias("node"))
    writers = _uses(spark, sf, _WRITES).select(F.col("src").alias("node")).distinct()
    return flow.tainted(_refs(spark, sf), of("entry is not null"), of("kind = 'var'"), of("kind = 'function'").join(writers, "node", "anti"))


_OWN = f", own AS (SELECT src AS fn, 'write' AS kind, dst AS key, min(rw - 1)::BIGINT AS tier FROM edges WHERE {_WRITES} GROUP BY 1, 3), es AS (SELECT * FROM own UNION SELECT r.src, es.kind, key, es.tier FROM es JOIN refs r ON r.dst = fn), ef AS (SELECT fn, kind, key, min(tier) AS tier FROM es GROUP BY 1, 2, 3)"


def _effects(spark, sf) -> DataFrame:
    own = _uses(spark, sf, _WRITES).groupBy(F.col("src").alias("fn"), F.lit("write").alias("kind"), F.col("dst").alias("key")).agg(F.min(F.col("rw") - 1).cast("long").alias("tier"))
    return flow.effects(_refs(spark, sf), own)


@query(_OWN + " SELECT * FROM ef")
def effects_summary_graph(spark, sf):
    return _effects(spark, sf)


@query(_OWN + " SELECT id AS fn, CASE WHEN id IN (SELECT fn FROM ef) THEN 'writes' ELSE 'pure' END AS label FROM nodes WHERE kind = 'function'")
def purity_labels_graph(spark, sf):
    return flow.purity(from_star(spark, sf).nodes.where("kind = 'function'").select(F.col("id").alias("fn")), _effects(spark, sf))


@query(", lc AS (SELECT id AS fn, 0::BIGINT AS depth FROM nodes UNION SELECT src, depth + (n > 1)::BIGINT FROM lc JOIN refs ON dst = fn) SELECT fn, max(depth) AS depth FROM lc GROUP BY 1")
def loop_cost_graph(spark, sf):
    g = from_star(spark, sf)
    return flow.loop_depth(g.nodes.select(F.col("id").alias("fn"), F.lit(0).cast("long").alias("own")), g.refs().select("src", "dst", (F.col("n") > 1).cast("long").alias("loops")))


# A customer's order hangs from the customer; what several of its orders lead to does too, else from the one order.
@query(_EDGES + """, rt AS (SELECT id AS root FROM nodes WHERE entry IS NOT NULL), l1 AS (SELECT root, dst AS node FROM rt JOIN we ON src = root), l2 AS (SELECT root, dst AS node, count(*) AS n, min(node) AS via FROM l1 JOIN we ON src = node GROUP BY 1, 2)
SELECT root, node, root AS idom, 1 AS depth FROM l1 UNION ALL SELECT root, node, CASE WHEN n > 1 THEN root ELSE via END, CASE WHEN n > 1 THEN 1 ELSE 2 END FROM l2""")
def dominators_graph(spark, sf):
    return flow.dominators(_edges(spark, sf), from_star(spark, sf).nodes.where("entry is not null").select(F.col("id").alias("root")))


# A node's layer is its file.
@query(_EDGES + """ SELECT CASE WHEN ba > ab THEN b ELSE a END AS upper, CASE WHEN ba > ab THEN a ELSE b END AS lower, greatest(ab, ba) AS forward, least(ab, ba) AS backward, least(ab, ba) > 0 AND 4 * least(ab, ba) <= greatest(ab, ba) AS violation FROM (
  SELECT least(x.file, y.file) AS a, greatest(x.file, y.file) AS b, count(*) FILTER (x.file < y.file) AS ab, count(*) FILTER (x.file > y.file) AS ba FROM we JOIN nodes x ON src = x.id JOIN nodes y ON dst = y.id WHERE x.file <> y.file GROUP BY 1, 2)""")
def layering_matrix_graph(spark, sf):
    return slices.layering(_edges(spark, sf), from_star(spark, sf).nodes.select("id", "file"))
