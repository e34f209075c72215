import random

import duckdb
import pytest
from pyspark.sql import functions as F

from skein import analyses
from skein.operators import flow, registries, scopes

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(analyses.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = analyses.QUERIES[name](spark, SF), con.sql(analyses.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_dominators_equal_removal(spark):
    r = random.Random(5)
    pairs = sorted({(r.randrange(18), r.randrange(18)) for _ in range(34)})

    def reach(gone):
        seen, todo = set(), [] if gone == 0 else [0]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b for a, b in pairs if a == x and b != gone]
        return seen

    every = reach(None)
    over = {v: {g for g in every if g != v and v not in reach(g)} for v in every}
    want = {(0, v, max(over[v], key=lambda g: len(over[g])), len(over[v])) for v in every if v}
    got = flow.dominators(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(0,)], "root long"))
    assert len(every) > 10 and rows(got) == want


def test_innermost_range_of_all_lengths(spark):
    r = random.Random(6)
    ranges = [("f", i, s, s + r.choice([-1, 0, 1, 7, 8, 100, 5000])) for i, s in enumerate(r.randrange(-50, 3000) for _ in range(60))]
    points = sorted({("f", r.randrange(-60, 8000)) for _ in range(80)})
    want = set()
    for f, p in points:
        if inside := sorted((e - s, -s, i) for _, i, s, e in ranges if s <= p <= e):
            want.add((f, p, inside[0][2], len(inside)))
    got = scopes.node_at(spark.createDataFrame(points, "file string, line long"), spark.createDataFrame(ranges, "file string, id long, sl long, el long"))
    assert rows(got) == want


def test_definitions_stop_at_redefinitions(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "src string, dst string")
    defs = spark.createDataFrame([("a", "x"), ("c", "x")], "node string, var string")
    assert rows(flow.reaching(e, defs)) == {("b", "x", "a"), ("c", "x", "a"), ("b", "x", "c"), ("c", "x", "c"), ("d", "x", "c")}
    assert rows(flow.live(e, spark.createDataFrame([("d", "x"), ("b", "y")], "node string, var string"), defs)) == {("d", "x"), ("b", "y"), ("a", "y"), ("c", "y")}


def test_near_names_find_swaps_and_families_follow_chains(spark):
    names = spark.createDataFrame([(1, "handler"), (2, "hnadler"), (3, "handlers"), (4, "other"), (5, "ab"), (6, "ba"), (7, None), (8, "")], "id int, name string")
    assert rows(registries.near_pairs(names)) == {("handler", "hnadler", 1), ("handler", "handlers", 1), ("hnadler", "handlers", 2), ("ab", "ba", 1)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 31)], "a int, b int")
    assert rows(registries.connected(chain)) == {(i, 1) for i in range(1, 21)} | {(30, 30), (31, 30)}


def test_loops_of_calls_raise(spark):
    with pytest.raises(RuntimeError):
        flow.loop_depth(spark.createDataFrame([("a", 0), ("b", 0)], "fn string, own int"), spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, loops int"), rounds=5)


def test_last_value_crosses_parts_and_rows_without_an_owner_stay(spark):
    r = spark.createDataFrame([("u", 1, 1, "a"), ("u", 1, 2, None), ("u", 2, 3, None), ("u", 4, 4, "b"), ("u", 4, 5, None), (None, 1, 6, "c"), (None, 1, 7, None)], "u string, p int, t int, v string")
    got = scopes.last_before(r, "u", F.col("p"), ["t"], F.col("v")).select("t", "last")
    assert rows(got) == {(1, None), (2, "a"), (3, "a"), (4, "a"), (5, "b"), (6, None), (7, None)}
