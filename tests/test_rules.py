import itertools

import pytest

from skein.plans.rules import Lit, Rule, saturate


def facts(spark, *rows):
    return spark.createDataFrame([*rows], ", ".join(f"c{i} long" for i in range(len(rows[0]))))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_paths_of_a_cyclic_graph_equal_brute_force(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 2), (4, 5), (6, 7), (8, 8)]
    want = {*edges}
    while more := {(a, d) for (a, b), (c, d) in itertools.product(want, want) if b == c} - want:
        want |= more
    got = saturate({"edge": facts(spark, *edges)}, [Rule(("path", ("x", "y")), (("edge", ("x", "y")),)), Rule(("path", ("x", "z")), (("path", ("x", "y")), ("path", ("y", "z"))))])
    assert rows(got["path"]) == sorted(want)


def test_literals_repeated_variables_and_negation(spark):
    edge = {"edge": facts(spark, (1, 1), (1, 2), (2, 2), (2, 3))}
    loop = Rule(("loop", ("x",)), (("edge", ("x", "x")),))
    assert rows(saturate(edge, [loop])["loop"]) == [(1,), (2,)]
    assert rows(saturate(edge, [Rule(("from", (Lit(9), "y")), (("edge", (Lit(2), "y")),))])["from"]) == [(9, 2), (9, 3)]
    plain = Rule(("plain", ("x", "y")), (("edge", ("x", "y")),), (("loop", ("y",)),))
    assert rows(saturate(edge, [loop, plain])["plain"]) == [(2, 3)]
    assert rows(saturate(edge, [Rule(("all", ("x", "y")), (("edge", ("x", "y")),), (("none", ("x",)),))])["all"]) == [(1, 1), (1, 2), (2, 2), (2, 3)]
    assert rows(saturate(edge, [Rule(("no", ("x",)), (("edge", ("x", Lit(77))),))])["no"]) == []


def test_mutual_recursion_and_the_cap(spark):
    step = {"step": facts(spark, *((i, i + 1) for i in range(6))), "start": facts(spark, (0,))}
    rules = [Rule(("even", ("x",)), (("start", ("x",)),)), Rule(("odd", ("y",)), (("even", ("x",)), ("step", ("x", "y")))), Rule(("even", ("y",)), (("odd", ("x",)), ("step", ("x", "y"))))]
    got = saturate(step, rules)
    assert rows(got["even"]) == [(0,), (2,), (4,), (6,)] and rows(got["odd"]) == [(1,), (3,), (5,)]
    with pytest.raises(RuntimeError):
        saturate(step, rules, cap=2)
    with pytest.raises(ValueError):
        saturate(step, [Rule(("odd", ("z",)), (("start", ("x",)),))])
