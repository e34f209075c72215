from pyspark.sql import functions as F

from skein.functions.text import osa, version_key
from skein.operators import diffs, reach, slices
from skein.plans.rules import Rule, plan_reach, saturate
from skein.streaming.windows import read_events, windowed


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_territory_core_and_commons(spark):
    e = edges(spark, ("e1", "a"), ("e2", "b"), ("e3", "c"), ("a", "sh12"), ("a", "core"), ("b", "sh12"), ("b", "core"), ("c", "core"))
    got = rows(reach.territory(e, spark.createDataFrame([("e1",), ("e2",), ("e3",)], "root string")))
    assert {("a", 1, "territory"), ("sh12", 2, "commons"), ("core", 3, "core"), ("e1", 1, "territory")} <= got


def test_components_and_levels(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"))
    assert rows(reach.components(e)) == {("a", "a"), ("b", "b"), ("c", "b"), ("d", "d")}
    assert rows(reach.levels(e)) == {("d", 0), ("b", 1), ("a", 2)}


def test_cone_leaves_out_its_anchor_on_a_cycle(spark):
    e = edges(spark, ("a", "b"), ("b", "a"), ("b", "c"))
    assert {(r.root, r.node) for r in reach.cone(e, spark.createDataFrame([("a",)], "root string")).collect()} == {("a", "b"), ("a", "c")}


def test_rules_reach_a_fixpoint_and_negate(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 5)], "c0 int, c1 int")
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "c0 int")
    path = [Rule(("path", ("x", "y")), (("edge", ("x", "y")),)), Rule(("path", ("x", "z")), (("path", ("x", "y")), ("edge", ("y", "z"))))]
    got = saturate({"edge": chain, "node": nodes}, [*path, Rule(("back", ("x", "y")), (("edge", ("x", "y")),), (("path", ("y", "x")),))])
    assert got["path"].count() == 10 and (1, 5) in rows(got["path"]) and got["back"].count() == 4


def test_plan_strategies_agree(spark):
    e = edges(spark, ("a", "b"), ("b", "c"))
    seeds = spark.createDataFrame([("a",)], "root string")
    (few, x), (many, y) = plan_reach(e, seeds, 100, 1), plan_reach(e, seeds, 3, 1)
    assert (few, many) == ("per-seed", "shared") and rows(x) == rows(y)


def test_diff_counts_multisets(spark):
    kind = "src string, dst string, sig int"
    a, b = spark.createDataFrame([("x", "y", 1), ("x", "y", 1), ("p", "q", 1)], kind), spark.createDataFrame([("x", "y", 1), ("n", "m", 1)], kind)
    assert rows(diffs.edge_diff(a, b, ["src", "dst"], "sig")) == {("x", "y", "changed"), ("p", "q", "removed"), ("n", "m", "added")}


def test_coupling_confidence(spark):
    t = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "C"), (3, "A"), (3, "B")], "commit int, symbol string")
    assert rows(diffs.coupling(t)) == {("A", "B", 2, 2 / 3)}


def test_atlas_labels(spark):
    uses = spark.createDataFrame([("CONST", 1), ("DEAD", 2), ("M", 2), ("M", 3), ("S", 3), ("U", None)], "dst string, rw int")
    assert {(r["var"], r.label) for r in slices.atlas(uses).collect()} == {("CONST", "const"), ("DEAD", "dead"), ("M", "multi-writer"), ("S", "single-writer"), ("U", "unclassified")}


def test_names_and_versions(spark):
    assert osa("ab", "ba") == 1 and osa("abc", "abd") == 1 and osa("", "ab") == 2
    one = spark.range(1)
    assert one.select((version_key(F.lit("1.10")) > version_key(F.lit("1.9.7"))).alias("x")).first().x


def test_stream_equals_table(spark, tmp_path):
    df = spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,cast(id as int)) ts, id % 3 user_id, if(id % 2 = 0, 'view', 'click') event_type from range(300)")
    df.write.parquet(str(tmp_path / "in"))
    q = windowed(read_events(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.start, r.event_type, r.n) for r in spark.table("w").collect()} == {(r.start, r.event_type, r.n) for r in windowed(df).collect()}
