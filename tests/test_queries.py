import duckdb
import pytest

from skein import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", ["edges_callers", "ladder", "atlas_labels", "graphdiff", "clones_exact", "mentions_postings", "pair_audit", "heat_roles", "coupling_partners", "confirm_diff", "percentile_summary"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF), con.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
