"""Pipeline stages on rows without an id and with a repeated one."""

from __future__ import annotations

import corpus_pipeline as C


def test_rows_without_an_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    clean, other = ("one two three four five six seven eight nine ten eleven " * 2, "red green blue white black brown pink grey teal gold lime " * 2)
    rows = [(1, clean), (2, clean), (2, clean), (3, other), (None, clean), (None, "quoted: " + item), (None, None), (4, item)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)

    def texts(frame):
        return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)

    # equal texts are copies; the least id of them stays, and every row without one
    first = {}
    for i, t in rows:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    assert texts(C.one_of_near_copies(spark, table, sf_dir)) == sorted((x for x in rows if x[0] is None or first[x[1]] == x[0]), key=str)
    got = C.without_benchmark(spark, table, sf_dir)
    assert got.columns == list(C.COLUMNS)
    assert texts(got) == sorted((x for x in rows if item not in (x[1] or "")), key=str)
