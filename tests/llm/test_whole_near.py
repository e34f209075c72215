import corpus_pipeline
from skein.llm import near


def test_the_stage_links_at_80_and_op4_at_85(spark, tmp_path):
    words = [f"w{i}" for i in range(104)]
    # 100 shingles each, 90 of them shared: similarity 90 / 110 = 0.818.
    rows = [(1, " ".join(words)), (2, " ".join(words[:94] + [f"x{i}" for i in range(10)])), (3, " ".join(f"y{i}" for i in range(104)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()} == {1, 3}
    assert {r.doc_id: r.component_id for r in near.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.component_id for r in near.op4_near_duplicates(spark, str(tmp_path)).collect()} == {1: 1, 2: 2, 3: 3}
