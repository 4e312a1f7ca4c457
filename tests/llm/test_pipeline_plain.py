"""The whole pipeline, and the languages of a table, against plain Python."""

from __future__ import annotations

import math
from hashlib import sha256

import pytest
from test_passages import cut_lines
from test_templates import share, split
from test_texts import plain_fingerprint, plain_groups, plain_phrases

import corpus_pipeline as C
from planewise.llm import language, pieces

SHORTEST, DOCS, ITEMS = 1500, 45, 8


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """Short documents of the given table with copies, lines that repeat, quotes, and rows without id, text or letters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(ITEMS).collect()]
    rows = [(r.doc_id, r.text, r.lang) for r in docs.where(docs.n_chars < SHORTEST).orderBy("doc_id").limit(DOCS).collect()]
    long = max((t for _, t, _ in rows), key=len)
    lines = "first line here\nsecond line here\nthird line here\n"
    odd = [
        (9001, long), (9002, long + " more"), (9003, long), (9003, long),
        (9010, lines + "tail of one"), (9011, "head of another\n" + lines), (9012, lines.strip()), (9012, "something else altogether stands here"),
        (9020, "as asked: " + items[0] + " and so on"), (9021, items[1]), (9022, "12 345 ... !"), (9023, None), (9024, ""), (9025, " \n\n "),
        (None, lines + "without an id"), (None, long), (None, items[2]), (None, None),
    ]
    rows += [(i, t, "en") for i, t in odd]
    folder = str(tmp_path_factory.mktemp("plain"))
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], docs.schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def plain_pipeline(spark, rows, items):
    rows = [(i, t) for i, t, _ in rows if any(c.isalpha() for c in t or "")]
    rows = [(i, kept) for i, kept, _, removed in cut_lines(rows) if kept != "" or not removed]
    # copies: the nodes are rows, of which those without an id link others but name no group
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    groups = plain_groups({n: plain_fingerprint(rows[k][1]) for n, k in enumerate(order)})
    least = {n: rows[order[g]][0] for n, g in groups.items()}
    first = {rows[k][0] for n, k in enumerate(order) if rows[k][0] is not None and rows[k][0] == least[n]}
    rows = [(i, t) for i, t in rows if i is None or i in first]
    x = split(spark, [t for _, t in rows])
    y = split(spark, items) + [b[1:] for b in split(spark, ["a " + t.lstrip() for t in items])]
    keys = [i if i is not None else t for i, t in rows]
    gone = {key for key, a in zip(keys, x, strict=True) if any(share(a, b) for b in y)}
    rows = [row for row, key in zip(rows, keys, strict=True) if key not in gone]
    library = pieces.merger(pieces.default_model()).library
    for i, t in rows:
        ids = library.encode(t, num_threads=1)
        yield i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest()


def test_run(spark, tables):
    folder, rows, items = tables
    want = sorted(plain_pipeline(spark, rows, items), key=str)
    got = C.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=str) == want
    kept = {i for i, *_ in want}
    assert not kept & {9001, 9003, 9020, 9021, 9022, 9023, 9024, 9025} and {9010, None} <= kept


def test_languages_of_a_table(spark, tables):
    """Every prediction and score, by longest matches found with substring search."""
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    samples = language.learn(docs)
    known = {lang: "".join(map(chr, language.letters(s))) for lang, s in sorted(samples.items())}
    assert len(known) > 1
    for r in language.identify(docs, samples).select("row.text", "lang_pred", "score").collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        x = "".join(map(chr, language.letters(r.text)))
        needed = sorted((plain_phrases(x, k) * math.log2(len(k) + 1), lang) for lang, k in known.items())
        assert r.lang_pred == needed[0][1]
        assert math.isclose(r.score, 1 - needed[0][0] / needed[1][0], abs_tol=1e-12)
