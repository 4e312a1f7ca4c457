from __future__ import annotations

import numpy as np
import pytest

from planewise.llm import pages, vectors
from planewise.llm.registry import op8_nearest_neighbours, op9_main_text

PAGES = [
    ("", ""),
    ("plain < text &amp; more", "plain < text & more"),
    ("<html><body><header><h1>Site</h1></header><main><h1>T &eacute;</h1><p>a<br>b<p>c <i>d</i>e<ul><li>x<li>y</ul></main><aside>no</aside>", "T é\na b\nc de\nx\ny"),
    ("<body><div id=content><p>Hi&nbsp;there</div><div class='cookie-notice'>n</div><section id='comments'><p>bad</section>", "Hi there"),
    ("<article><p>ok</p><script>if(a<b){'</p>'}</script><p>two</p><div class=share>s</div><form>f</form></article><article class=comment>no</article>", "ok\ntwo"),
    ("<p>a<p", "a"),
    ('<p title="x>y">q</p><p title="open>r</p>', "q\nr"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_main_text(html, text):
    assert pages.main_text(html) == text


def test_unimportant_branches_go(spark):
    """What all pages of a host say in one place is template; on a host with few pages, and in copies, it stays."""
    body = "<body><div class=line>All rights of this site</div><div class=text><p>{}</p></div>"
    rows = [(k, "http://a.example/x", body.format(f"text number {k} " * 3)) for k in range(12)]
    rows += [(100 + k, "http://b.example/", body.format(f"other {k} " * 3)) for k in range(3)]
    rows += [(200 + k, "http://c.example/", body.format("the same page again and again and again")) for k in range(12)]
    rows += [(300, None, None), (None, "no url", "<p>x"), (0, "http://a.example/x", rows[0][2])]
    got = [tuple(r) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(got) == len(rows)
    for i, url, text, n in got:
        assert n == len(text)
        if url and "a.example" in url:
            assert text == " ".join(f"text number {i}" for _ in range(3))
        elif i is not None and 100 <= i < 300:
            assert text.startswith("All rights of this site\n")
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pages_registered(spark, sf_dir):
    got = op9_main_text(spark, sf_dir).collect()
    assert len(got) == 50 and all(r.text and "&amp;" not in r.text and "<p>" not in r.text for r in got)


def brute(rows, every, k):
    sound = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in sound:
        if i % every == 0:
            out[i] = sorted(((-float((x * v).sum()), j) for j, x in sound if j != i))[:k]
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_recall(spark, sf_dir, size):
    sf_dir = f"{sf_dir.rsplit('/', 1)[0]}/{size}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows, 20, 20)
    got: dict = {}
    for r in op8_nearest_neighbours(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    assert all([x[0] for x in sorted(v)] == list(range(1, 21)) for v in got.values())
    assert np.mean([len({j for _, j, _ in got[q]} & {j for _, j in want[q]}) / 20 for q in want]) >= 0.9
    assert all(got[q] and sorted(got[q]) == [(n + 1, j, s) for n, (_, j, s) in enumerate(sorted(got[q], key=lambda x: (-x[2], x[1])))] for q in got)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=64).tolist()) for i in range(30)] + [(100 + i, [1.0] * 64) for i in range(60)]
    rows += [(None, [1.0] * 64), (300, None), (320, [0.0] * 64), (340, [float("nan")] * 64), (360, [None] * 64), (380, [1.0])]
    want = brute(rows, 20, 20)
    got: dict = {}
    for r in vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == set(want)
    assert [j for _, j in sorted(got[100])] == [j for _, j in want[100]]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"]) for r in vectors.nearest(few, 20).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert vectors.nearest(few.limit(0), 20).collect() == []


def test_vectors_given_very_often(spark, monkeypatch):
    """Beyond the bound, only the smallest ids of a vector are indexed; the answers are those of all rows."""
    monkeypatch.setattr(vectors, "UNIT", 30)
    monkeypatch.setattr(vectors, "GROUP", 50)
    rng = np.random.default_rng(9)
    often = rng.normal(size=64).tolist()
    rows = [(int(i), rng.normal(size=64).tolist()) for i in range(40)] + [(100 + i, often) for i in range(200)] + [(101, often)] * 40
    want = brute(rows[:240], 20, 20)
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, list int, code string")
    got: dict = {}
    for r in vectors.nearest(table, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == set(want)
    for q in (i for i in want if i >= 100):
        assert [j for _, j in sorted(got[q])] == [j for _, j in want[q]]
