import re

import duckdb
import pytest

from skein.llm import license_scan

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("text,ids,met,form", [
    (b"MIT OR GPL-2.0", {"mit", "gpl-2.0"}, True, "(mit or gpl-2.0)"), (b"MIT AND GPL-2.0", {"mit", "gpl-2.0"}, False, "(mit and gpl-2.0)"),
    (b"GPL-2.0 AND MIT OR ISC", {"gpl-2.0", "mit", "isc"}, True, "((gpl-2.0 and mit) or isc)"), (b"GPL-2.0 AND (MIT OR ISC)", {"gpl-2.0", "mit", "isc"}, False, "(gpl-2.0 and (mit or isc))"),
    (b"Apache-2.0 WITH LLVM-exception", {"apache-2.0 with llvm-exception"}, True, "apache-2.0 with llvm-exception"),
])
def test_expressions_are_evaluated(text, ids, met, form):
    sound, values = license_scan.parse(text)
    assert sound and license_scan.evaluate(text) == (True, ids) and values == [(values[0][0], met, form)]


def test_tags_stand_where_the_automaton_finds_them():
    got = license_scan.scan("é x // SPDX-License-Identifier: MIT\nspdx license identifier: ISC\n# spdx-license-identifier : GPL-2.0 OR".encode())
    assert got[-1] == [(2, "mit", "tag"), (10, "gpl-2.0", "odd")] and got[7] is True and got[8] == ["mit"] and got[5] == "gpl-2.0,mit"
    assert license_scan.scan(b"no tag")[7] is None


def test_base_columns_equal_sql_and_repeats_and_clashes_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 score", "2 labels")
    odd = spark.createDataFrame([(-1, "Under the MIT license under, the; mit license."), (-2, None), (-2, None), (-3, "cc by nc" * 3), (-4, "cc by nc " * 9000)], "doc_id long, text string")
    rows = docs.unionByName(odd, allowMissingColumns=True)
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.license_scan(rows).collect()]
    want = []
    for i, text in rows.select("doc_id", "text").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hits = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in hits]
        want.append((i, len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == rows.count()
    n = duckdb.sql(f"select sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) from '{SF}/documents.parquet'").fetchall()[0][0]
    assert sum(r[1] for r in got if r[0] >= 0) == n
