import duckdb
import pytest

from skein import catalog
from skein.sources.graph import from_star

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["impact", "confirm_diff"])
def test_every_symbol_and_year_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem documents".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_every_referenced_node_is_moved_once(spark):
    moved = [r.dst for r in catalog.QUERIES["impact"](spark, SF).select("dst").collect()]
    assert len(moved) == len(set(moved)) and set(moved) == {r.dst for r in from_star(spark, SF).refs().select("dst").distinct().collect()}
