import hashlib
import re
import zlib

import numpy as np
import pytest

from skein.llm import ann, contamination, huffman, license_scan, mixing, near, token_files, toxicity, url_filter, warc
from skein.llm.shared import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string"
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [
    (1, "a b c d e f g h i j k l", "en", "s1", 1, "x"), (2, "A b c d e f g h i j k l", "en", "s1", 1, None), (3, None, None, None, None, None), (4, "", "en", "s2", 0, "x"),
    (5, "one two", "en", "s2", 7, "x"), (6, "one two", "de", None, 7, "x"), (6, "one two", "de", None, 7, "x"), (None, "no id at all here today", "fr", "s3", 2, "x"), (7, LONG, "en", "s1", 3, "x"), (8, LONG + " z", "en", "s1", 3, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates(docs, none):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(docs).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == len(ROWS) and near.near_duplicates(none).count() == 0
    assert by[2] == (2, 8, 1, False) and by[3] == (3, 0, 3, True) and by[4] == (4, 0, 4, True) and by[6] == (6, 1, 5, False) and by[8][2] == 7 and by[7][3] and by[None][3]
    assert near.without_duplicates(docs).count() == 6


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
    b = np.concatenate([a[:360], rng.integers(1, 1 << 63, 40, dtype=np.uint64)])
    with np.errstate(over="ignore"):
        agree = (near.sketch(a, 256) == near.sketch(b, 256)).mean()
        assert abs(agree - 360 / 440) < 0.12 and (near.sketch(a[:3]) != ~np.uint64(0)).all()


def test_contamination_by_brute_force(spark, docs, none):
    items = spark.createDataFrame([(1, "x b c d e f g h i j k"), (2, "two"), (3, ""), (4, None), (None, "one")], "item_id long, text string")
    got = {r.doc_id: r for r in contamination.digest(contamination.contamination(docs, items)).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].items_sha256) == (10, 1, hashlib.sha256(b"1").hexdigest())
    assert got[5].n_hit == 1 and got[3].n_words == 0 and not got[7].contaminated and got[4].items_sha256 == hashlib.sha256(b"").hexdigest()
    blocks = contamination.digest(contamination.contamination(docs, items, block_words=3))
    assert sorted(map(repr, blocks.collect())) == sorted(map(repr, contamination.digest(contamination.contamination(docs, items)).collect()))
    assert contamination.contamination(none, items).count() == 0 and contamination.contamination(docs, items.limit(0)).where("size(starts) > 0").count() == 0


def test_token_files_round_trip(spark, docs, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    token_files.write_token_files(docs, to := scratch(spark, "t"), path, file_ids=1000)
    got = sorted(token_files.read_token_files(spark, to).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda x: -1 if x is None else x)
    texts, start = {r[0]: r[1] for r in ROWS}, 0
    for r in got:
        ids = np.array([*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert (r.start, bytes(r.ids), r.ids_crc32) == (start, ids, zlib.crc32(ids))
        start += r.n_tokens
    token_files.write_token_files(none, to := scratch(spark, "t"), path)
    assert token_files.read_token_files(spark, to).count() == 0


@pytest.mark.parametrize("n", [1, 2, 1000, 70_000])
def test_huffman(n):
    ids = np.minimum(np.random.default_rng(n).geometric(0.01, n), 4999)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=5000))
    assert (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1 and lengths.max() <= huffman.LIMIT
    data = huffman.write({"part": 0}, [1], np.array([n]), ids, lengths, huffman.codes(lengths))
    assert (huffman.read(data)[3] == ids).all()
    with pytest.raises(ValueError):
        huffman.header(data[:-1])


@pytest.mark.parametrize("block, most", [(1 << 20, 3), (17, 40), (300, 500_000)])
def test_words_are_encoded_as_in_whole_texts(monkeypatch, block, most):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["İstanbul KK ß ſ <|endoftext|> x<|EndOfText|>y don't we're 1.2.3, A1b2. (bar)!? a\x1cb é. —, 日本語。", "'s o'Re,", ""]
    rng, tokenizer = np.random.default_rng(5), Tokenizer.from_file(path)
    letters = [*"abzAZ019 \t\n\x0b\x1c\x00.,-_^'<|>\u0301\u00a0\u0085\u2028éÉß÷×ÿÀŸİſKª日", "'s", "'LL", " l'", "<|endoftext|>", "<|StartOfText|>", "abcdefghijklm"]
    texts += ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(1500)]
    monkeypatch.setattr(token_files, "BLOCK", block)
    data = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, data)])
    encoder = token_files.WordIds(path, 1, most=most)
    for _ in range(2):
        ids, n = encoder.encode(np.frombuffer(b"".join(data), np.uint8), at)
        want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]


def test_licences(docs, none):
    text = b"Under the MIT-License; SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND ISC"
    got = license_scan.scan(text)
    assert got[1:5] == (1, 0, 0, "mit") and set(got[5].split(",")) == {"mit", "isc", "gpl-2.0-only with classpath-exception-2.0"} and got[6] == 1.0
    assert license_scan.evaluate(b"MIT OR") == (False, {"mit"}) and license_scan.evaluate(b"") == (False, set())
    rows = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert (rows[3].n_words, rows[3].n_base, rows[3].first_word, rows[3].labels, rows[3].score) == (0, 0, None, "", 0.0) and rows[7].n_words == 30_000
    assert license_scan.license_scan(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 3 * r["size"] for r in got) and mixing.mix(none).count() == 0
    per = {}
    for r in got:
        per.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - k) <= 3 for t, k in per.values()) and abs(sum(t for t, _ in per.values()) - sum(r["size"] for r in got)) < 1e-6
    assert mixing.mixed(docs).columns == docs.columns


def test_toxicity(spark, none):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{k}" for k in rng.integers(0, 200, 40)]
        if i % 5 == 0:
            words[7] = ["vile", "foul", "nasty"][i % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame([*rows, (None, None), (-1, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > 0.95 and all(0 <= r.score <= 1 for r in got.values()) and len(got) == 902
    assert toxicity.score(none, toxicity.fit(none, none.selectExpr("doc_id", "1 toxic"))).count() == 0


def test_archives(spark):
    kind = "page_id long, url string, html string, more int"
    pages = spark.createDataFrame([(1, "u", "same", 1), (2, "v\n", "same", 1), (2, "v\n", "same", 1), (3, None, None, 1), (None, "w", "", 1), (4, "x", "é" * 400_000, 1)], kind)
    warc.write_archives(pages, to := scratch(spark, "w"))
    got = warc.read_archives(spark, to).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got if r.page_id != 4) == [(0, 0, "revisit", 3), (1, 4, "revisit", 2), (2, 4, "response", -1), (2, 4, "revisit", 2), (3, 0, "response", -1)]
    assert sum(r.record_type == "response" for r in got) == 3 and len(got) == 6 and {r.refers_to for r in got if r.page_id == 1} == {2}
    for f in warc.read_files(spark, to).collect():
        data = bytes(f.content)
        for me, *_ in warc.record_index(data):
            assert warc.fetch(data, me)["warc-record-id"] == me
    warc.write_archives(pages.limit(0), to := scratch(spark, "w"))
    assert warc.read_archives(spark, to).count() == 0


def test_nearest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).round(4)
    x[40:70] = x[0]
    odd = [(9001, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [None] * 16), (9080, []), (None, x[1].tolist())]
    rows = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), *odd], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(rows, shard=400).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == set(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len({v for _, v in found} & set(np.lexsort((np.arange(1500), -s.round(9)))[:20].tolist()))
    assert hit / (20 * len(got)) > 0.95 and ann.nearest(rows.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/x?q#f", None), (2, "https://a.example.com/en/", None), (3, "http://x.net/es/1", '<a href="http://bad.org/">'), (4, "http://bad.org/a", '<a href="//x.net/">'), (5, None, None), (6, "no scheme", ""), (7, "http://x.com", None)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[2][2:] == ("example.com/en/", "block") and got[3][2:] == ("net/es/", "block")
    assert got[4] == ("bad.org", "/a", None, "block") and got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7] == ("x.com", "", None, "allow")


def test_merges_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, rng = Tokenizer.from_file(path), np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdeéñüst"), rng.integers(1, 20))) for _ in range(2000)] + ["a", "aaaaaaaaaaaa", "é"]
    data = [w.encode() for w in words]
    length = np.array([len(w) for w in data])
    ids, size = token_files.Merges.of(path).encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum(length) - length, length)
    want = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert ids.tolist() == sum(want, []) and size.tolist() == [len(w) for w in want]
