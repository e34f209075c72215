from itertools import combinations

import duckdb

from skein import catalog


def same_as_sql(spark, name, folder):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, folder).select(*want.columns)
    rows = {tuple(r) for r in got.collect()}
    assert sorted(rows) == sorted(want.fetchall())
    return rows


def test_large_groups_of_copies_are_linked(spark, tmp_path):
    docs = [(i, "copy of forty\nsecond line", "en") for i in range(40)] + [(100 + i, f"copy of seventy\nof it too\nown {i}", "en") for i in range(70)]
    docs += [(300, "rare one\nrare two\ncopy of forty", "en"), (301, "rare two\nrare one", "en"), (302, "rare one\nalone", "en"), (303, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = {tuple(r) for r in catalog.clones_near(spark, str(tmp_path)).select("a", "b", "shared").collect()}
    pairs = same_as_sql(spark, "clones_near_rescued", str(tmp_path))
    assert plain == {(300, 301, 2)}
    assert pairs == plain | {(a, b, 2) for a, b in combinations(range(40), 2)} | {(a, 300, 1) for a in range(40)}
    classes = same_as_sql(spark, "clones_near_classes", str(tmp_path))
    assert classes == {(i, 0, 40, 2) for i in range(40)} | {(100 + i, 100, 70, 2) for i in range(70)}


def test_block_lines_keep_digits_at_their_ends(spark, tmp_path):
    lines = [f"{i} line {i}" for i in range(12)]
    docs = [(0, "\n".join(lines), "en"), (1, "\n".join(["own"] + lines[3:9]), "en"), (2, " " + "\n ".join(lines[:4]), "en"), (3, None, "en"), (4, "", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(same_as_sql(spark, "clones_blocks", str(tmp_path))) == 6
