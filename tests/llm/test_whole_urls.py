import pytest

from skein.llm import url_filter


def test_distrust_reaches_the_far_end_of_a_chain(spark):
    rows = [(0, "http://b.example.com/en/", None), (1, "http://h1.org/", '<a href="http://b.example.com/en/">')]
    rows += [(i, f"http://h{i}.org/", f'<a href="http://h{i - 1}.org/">') for i in range(2, 15)] + [(99, "http://free.org/", '<a href="http://else.org/">')]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "block" for i in range(15)} | {99: "allow"}


def test_masses_are_converged_and_the_limit_raises(spark):
    links = [("a", "b", 2), ("b", "a", 1), ("b", "c", 3), ("c", "d", 1), ("d", "b", 1)]
    edges = spark.createDataFrame(links, "src string, dst string, w long")
    seeds = spark.createDataFrame([("a", "trust", 1.0), ("d", "distrust", 1.0)], "host string, kind string, mass double")
    want = {}
    for kind, seed, arcs in (("trust", "a", links), ("distrust", "d", [(d, s, w) for s, d, w in links])):
        out, rank = {}, {}
        for s, _, w in arcs:
            out[s] = out.get(s, 0) + w
        for _ in range(500):
            rank = {h: 0.15 * (h == seed) + sum(0.85 * rank.get(s, 0) * w / out[s] for s, d, w in arcs if d == h) for h in "abcd"}
        want[kind] = rank
    got = {r.host: r for r in url_filter.propagate(edges, seeds).collect()}
    assert all((got[h].distrust > got[h].trust) == (want["distrust"][h] > want["trust"][h]) for h in "abcd")
    with pytest.raises(RuntimeError):
        url_filter.propagate(edges, seeds, limit=1)
