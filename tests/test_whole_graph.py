import duckdb
import pytest

import __spark_entry__
from skein import whole

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem documents events".split()


@pytest.mark.parametrize("name", sorted(whole.QUERIES))
def test_query_over_all_edges_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(whole.ORACLES[name])
    got = __spark_entry__.queries()[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and (name == "call_cycles_graph" or len(got) > (100 if name == "layering_matrix_graph" else 1000))
