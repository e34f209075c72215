import random

import duckdb
import numpy as np
import pytest

import __spark_entry__
from skein import served
from skein.operators import clones, regions
from skein.sources import dumps
from skein.sources.graph import from_star

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem documents".split()


@pytest.mark.parametrize("name", sorted(served.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(served.ORACLES[name])
    got = __spark_entry__.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall())) and got.count() > 0


def test_dumps_read_as_they_were_written(spark, tmp_path):
    graph = from_star(spark, SF)
    dumps.write_dump(graph, f"{tmp_path}/lines")
    (tmp_path / "one.json").write_text('{"nodes": [{"id": "a", "name": "a", "kind": "var", "file": "f", "line": 3, "other": 1}],\n "edges": [], "root": "x"}')
    back = dumps.read_dump(spark, f"{tmp_path}/lines")
    for part in ("nodes", "edges", "calls"):
        assert getattr(back, part).exceptAll(getattr(graph, part)).isEmpty() and getattr(graph, part).exceptAll(getattr(back, part)).isEmpty()
    one = dumps.read_dump(spark, f"{tmp_path}/one.json", document=True)
    assert [tuple(r) for r in one.nodes.collect()] == [("a", "a", "var", "f", 3, None)] and one.calls.isEmpty() and one.edges.isEmpty()
    bad = spark.createDataFrame([("{",)], "value string")
    with pytest.raises(Exception, match="(?i)malformed"):
        dumps.from_lines(bad).nodes.collect()


def test_stamps_null_and_repeated(spark):
    old = spark.createDataFrame([("a", "1"), ("b", None), ("c", "1"), ("c", "2"), ("d", "1")], "file string, stamp string")
    new = spark.createDataFrame([("a", "1"), ("b", None), ("c", "2"), ("e", None)], "file string, stamp string")
    assert dict(map(tuple, dumps.stamp_diff(old, new).collect())) == {"a": "same", "b": "changed", "c": "same", "d": "deleted", "e": "added"}
    assert dumps.stamp_diff(old.limit(0), new.limit(0)).isEmpty()


def union_find(edges):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(top)}


def test_concerns_by_brute_force(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(150), draw.randrange(150)) for _ in range(90)] + [(1000 + i, 1001 + i) for i in range(300)] + [(5000, 6000 + i) for i in range(200)] + [(7, 7), (9999, 9999)]
    got = dict(map(tuple, regions.concerns(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == union_find(edges)
    assert regions.concerns(spark.createDataFrame([], "src long, dst long")).isEmpty()
    whole = [tuple(r) for r in from_star(spark, SF).edges.where("src <> dst").select("src", "dst").distinct().collect()]
    assert dict(map(tuple, served.concerns_graph(spark, SF).collect())) == union_find(whole)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_row_distance_by_brute_force():
    draw = random.Random(5)
    for _ in range(3000):
        a = [draw.randrange(3) for _ in range(draw.randrange(9))]
        b = list(a)
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randrange(2)] = [draw.randrange(3)] * draw.randrange(2)
        for most in (1, 2):
            assert clones.row_distance(np.array(a, "int64"), np.array(b, "int64"), most) == min(levenshtein(a, b), most + 1), (a, b)


def test_aligned_clones_by_brute_force(spark, tmp_path):
    draw, texts = random.Random(2), {}
    for family in range(12):
        rows = [f"row {family} {i}" for i in range(draw.randrange(4, 15))]
        for _ in range(5):
            copy = list(rows)
            for _ in range(draw.randrange(4)):
                at = draw.randrange(len(copy))
                copy[at : at + draw.randrange(2)] = [f"own {len(texts)} {at}"] * draw.randrange(2)
            texts[len(texts)] = copy
    docs = [(i, ".\n".join(rows)) for i, rows in texts.items()] + [(900, None), (901, ""), (902, "...")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for a in texts:
        for b in range(a + 1, len(texts)):
            d, n = levenshtein(texts[a], texts[b]), max(len(texts[a]), len(texts[b]))
            if len(set(texts[a]) & set(texts[b])) >= 2 and 1 <= d <= 2 and n - d >= 6:
                want.add((a, b, d, n - d))
    assert len(want) > 20 and {tuple(r) for r in served.clones_aligned(spark, str(tmp_path)).select("a", "b", "dist", "matched").collect()} == want


def test_regions_by_brute_force(spark):
    draw = random.Random(11)
    rows = {(f"e{draw.randrange(6)}", node) for node in range(60) for _ in range(draw.randrange(1, 6))}
    sets = {}
    for e, node in rows:
        sets.setdefault(node, set()).add(e)
    groups = {}
    for node, s in sets.items():
        groups.setdefault(frozenset(s), []).append(node)
    want = set()
    for s, nodes in groups.items():
        above = [t for t in groups if s < t]
        want.add((min(nodes), len(nodes), len(s), sum(not any(u < t for u in above) for t in above)))
    assert {tuple(r) for r in regions.region_order(spark.createDataFrame(sorted(rows), "root string, node long")).collect()} == want
