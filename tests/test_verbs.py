import duckdb
import pytest
from pyspark.sql import functions as F

from skein import verbs
from skein.operators import lints, lookups, sets

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(verbs.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = verbs.QUERIES[name](spark, SF), con.sql(verbs.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda found: sorted(repr([round(float(v), 9) if isinstance(v, float) or hasattr(v, "as_tuple") else v for v in r]) for r in found)
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_files_by_trailing_path(spark):
    paths = spark.createDataFrame([("a/b/c.lua",), ("a/d/c.lua",), ("x/only.lua",), ("x/only.lua",), ("xonly.lua",)], "path string")
    wanted = spark.createDataFrame([("c.lua",), ("b/c.lua",), ("only.lua",), ("none",), ("nly.lua",)], "q string")
    assert rows(lookups.resolve_files(paths, wanted)) == [("b/c.lua", 1, "a/b/c.lua", "resolved"), ("c.lua", 2, None, "ambiguous"), ("nly.lua", 0, None, "missing"), ("none", 0, None, "missing"), ("only.lua", 1, "x/only.lua", "resolved")]


def test_references_fall_back_to_witness_then_ordinal(spark):
    kind = "id string, file string, kind string, name string, witness long, ordinal long"
    nodes = spark.createDataFrame([("1", "f", "k", "one", 0, 1), ("2", "f", "k", "two", 5, 1), ("3", "f", "k", "two", 6, 2), ("4", "f", "k", "same", 7, 1), ("5", "f", "k", "same", 7, 2)], kind)
    refs = spark.createDataFrame([("a", "f", "k", "one", 9, 9), ("b", "f", "k", "two", 6, 1), ("c", "f", "k", "same", 7, 2), ("d", "f", "k", "same", 7, 3), ("e", "f", "k", "gone", 0, 1)], kind.replace("id", "ref"))
    assert rows(lookups.resolve_refs(refs, nodes)) == [("a", "1", "name"), ("b", "3", "witness"), ("c", "5", "ordinal"), ("d", None, "ambiguous"), ("e", None, "missing")]


def test_rungs_in_their_order(spark):
    calls = spark.createDataFrame([("t", True, True, True, 1), ("t", False, True, True, 1), ("t", False, False, True, 1), ("t", False, False, False, 1), (None, True, True, True, 1), (None, True, True, False, 2), (None, True, True, False, 0)], "target string, confirmed boolean, inferred boolean, dynamic boolean, n int")
    flags = {"confirmed": F.col("confirmed"), "inferred": F.col("inferred")}
    assert [r[0] for r in calls.select(lookups.rung(F.col("target"), flags, F.col("dynamic"), F.col("n"))).collect()] == ["confirmed", "inferred", "linked", "linked", "dynamic", "refused", "frontier"]


def test_tables_link_by_name_then_by_the_majority_prefix(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    got = rows(lookups.link_tables(names("Users", "posts", "gone", "wp_meta"), names("wp_users", "wp_posts", "wp_meta", "log")))
    assert got == [("gone", None, 0, "missing"), ("log", None, 0, "unused"), ("posts", "wp_posts", 1, "matched"), ("users", "wp_users", 1, "matched"), ("wp_meta", "wp_meta", 1, "matched")]
    assert lookups.prefix_of(names("a_x", "b_y")).count() == 0


def test_chains_say_where_they_end(spark):
    start = spark.createDataFrame([(1,), (2,), (3,)], "key long")
    link = lambda *x: spark.createDataFrame([*x], "src long, dst long")
    assert rows(lookups.chain(start, [(link((1, 10), (1, 11), (2, 12)), True), (link((10, 20), (11, 20)), False)])) == [(1, 2, 1, None), (2, 2, 1, "frontier"), (3, 1, 1, "absent")]


def test_rename_needs_one_lone_pair(spark):
    s = lambda *x: spark.createDataFrame([("f", "k", n) if isinstance(n, str) else n for n in x], "file string, kind string, name string")
    assert rows(sets.structural_delta(s("a", "b"), s("a", "c"))) == [("f", "k", 0, 0, 1)] and rows(sets.structural_delta(s("a"), s("a", "b", "c"))) == [("f", "k", 2, 0, 0)]
    c = spark.createDataFrame([(0, 0, 0, True), (0, 0, 0, False), (0, 0, 1, False), (1, 0, 1, False), (0, 2, 0, False), (1, 1, 0, False)], "a int, r int, n int, m boolean")
    assert [x[0] for x in c.select(sets.operation(F.col("a"), F.col("r"), F.col("n"), F.col("m"))).collect()] == ["rewire", "internal", "rename", "extract", "inline", "restructure"]


def test_vacuous_partitions_are_refused(spark):
    p = lambda *x: sets.partition_join(spark.createDataFrame([*x], "a int, b int"), "a", "b").first()
    assert p((1, 1), (2, 2)).same is True and p((1, 1), (1, 2), (2, 3)).same is False and p((1, 1), (1, 1)).same is None


def test_promises_need_what_they_are_closed_over():
    by = {r.name: r for r in lints.RULES}
    assert not by["dead-function"].holds_in("file") and by["dead-function"].holds_in("corpus") and by["access-point"].holds_in("fn") and by["redundant-require"].holds_in("file") and not by["redundant-require"].holds_in("fn")


def test_leaks_and_listeners(spark):
    steps = spark.createDataFrame([("f", "p", "acquire", 1), ("f", "p", "acquire", 2), ("f", "p", "release", 3), ("g", "q", "acquire", 1)], "fn string, var string, op string, t int")
    assert rows(lints.resource_leaks(steps, ["t"])) == [("f", "p", 1)] and rows(lints.member_leaks(steps)) == [("q", 1)]
    events = lambda *x: spark.createDataFrame([*x], "key string, op string")
    assert rows(lints.listener_audit(events(("a", "subscribe"), ("b", "register")))) == [("a", "kept"), ("a", "unregistered"), ("b", "unsubscribed")]
    assert rows(lints.listener_audit(events(("a", "subscribe"), (None, "register"), (None, "unsubscribe")))) == []
