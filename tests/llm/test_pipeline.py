from __future__ import annotations

import corpus_pipeline as C


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    counts = []
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == list(C.COLUMNS)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
    assert before >= counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    assert counts[2] < counts[1]  # the tables hold copies
    got = C.run(spark, sf_dir)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in docs.collect())


def test_only_letterless_documents_are_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(9001, "123 ... !!", "en", "s", 10), (9002, None, "en", "s", 0)], docs.schema)
    kept = {r.doc_id for r in C.known_language(spark, docs.unionByName(odd), sf_dir).collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}
