import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from skein.llm import contamination, mixing, shared

KIND = "doc_id long, text string, lang string, source string, n_chars long, size int, taken string, items string, starts string, n_words int, _row int, row string, _rows int, _id int, copies int, id string"
ITEM = " ".join(f"q{i}" for i in range(14))


def documents():
    rng = random.Random(11)
    rows = []
    for i in range(240):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 60))]
        if i % 6 == 0:
            words[len(words) // 2] = "vileword"
        rows.append((i, " ".join(words), "en", f"s{i % 3}" if i % 7 else None, 1))
    rows += [(300, rows[1][1], "en", "s0", 1), (301, "w1 " + ITEM + " w2", "de", "s1", 1), (302, None, None, None, None), (303, "", "en", "s1", 0), (304, "\n \t", "en", "s1", 3)]
    rows += [(305, " ".join(f"v{i}" for i in range(30_000)), "en", "s2", 1), (7, rows[7][1], "en", "s1", 1), (7, "another text of this id " + "x " * 9, "en", "s1", 1), (None, "no id " + "y " * 20, "en", "s1", 1), (None, "no id " + "z " * 20, "en", "s1", 1)]
    return [(*r, 5, "t", "i", "s", 6, 7, "r", 8, 9, 10, "d") for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(documents(), KIND).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_one_after_another(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.staged(stage(spark, docs, folder), name)
        kept[name] = docs.collect()
        assert docs.columns == columns
    before = documents()
    stays = {r.doc_id for r in kept["toxicity"]}
    assert sum(i in stays for i in range(0, 240, 6)) <= 4 and sum(i in stays for i in range(240) if i % 6) >= 196
    left = kept["near_duplicates"]
    assert len([r for r in left if r.doc_id in (1, 300)]) == (1 if {1, 300} & stays else 0) and len([r for r in left if r.doc_id == 7]) == 2 and len([r for r in left if r.doc_id is None]) == 2
    assert {302, 303, 304, 305} <= {r.doc_id for r in left} and all(r["size"] == 5 and r["id"] == "d" for r in left)
    clean = kept["decontamination"]
    assert sorted((r.doc_id or -1, r.text or "") for r in clean) == sorted((r.doc_id or -1, r.text or "") for r in left if r.doc_id != 301)
    texts = {(r[0], r[1]) for r in before}
    assert kept["mixing"] and all((r.doc_id, r.text) in texts and r.text.strip() for r in kept["mixing"])
    got = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [[*tokenizer.encode(r.text, add_special_tokens=False).ids, 1] for r in kept["mixing"]]
    want = sorted((r.doc_id or -1, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(kept["mixing"], ids))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == want and sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)


def test_stages_keep_an_empty_table_empty(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_the_mix_takes_whole_documents_near_its_targets(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("size(split(text, ' ')) < 100")
    count, words, most, target = {}, {}, {}, {}
    for r in mixing.mix(docs).collect():
        target[r.source] = r.target
        most[r.source] = max(most.get(r.source, 0), r["size"])
    for r in mixing.mixed(docs.repartition(5)).collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
        count[(r.doc_id, r.text)] = count.get((r.doc_id, r.text), 0) + 1
    assert all(abs(words.get(s, 0) - t) <= 2 * most[s] for s, t in target.items()) and max(count.values()) <= 6


def test_many_blocks_of_items_give_what_one_gives(spark, folder):
    docs, rng = spark.read.parquet(f"{folder}/documents.parquet"), random.Random(4)
    texts = [r.text for r in docs.where("length(text) > 80 and length(text) < 1000").limit(30).collect()]
    rows = [(i, " ".join(t.split()[2 : 2 + rng.choice([3, 10, 14])])) for i, t in enumerate(texts)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    one, many = (contamination.uncontaminated(docs, items, block_words=n) for n in (500_000, 12))
    assert one.columns == many.columns == docs.columns and sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))
    n = contamination.contamination(docs, items, block_words=12).where("size(starts) > 0").count()
    assert n >= len(texts) and one.count() == docs.count() - n


def test_files_hold_every_byte(spark):
    data = bytes(range(256)) * 3
    shared.write_files(spark.createDataFrame([(data,)], "data binary"), "data", to := shared.scratch(spark, "bytes"), b"\xffEND\x00")
    assert [bytes(r.content) for r in shared.read_files(spark, to).collect()] == [data + b"\xffEND\x00"]
