"""What a host's style tree drops and keeps."""

from __future__ import annotations

from planewise.llm import pages


def extract(spark, html):
    rows = [(k, "http://a.example/", h) for k, h in enumerate(html)]
    return [r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_own_titles_stay_beside_near_copies(spark):
    """A content that stands on most pages goes; the others at its path stay, as does one of three common values."""
    page = "<article><h1>{}</h1><div class=by>{}</div><p>{}</p></article>"
    people = ["Ann", "Ben", "Eve"]
    html = [page.format("Same title", people[k % 3], f"paragraph {k}") for k in range(2900)]
    html += [page.format(f"Title {k}", people[k % 3], f"clean {k}") for k in range(100)]
    got = extract(spark, html)
    assert got[:2900] == [f"{people[k % 3]}\nparagraph {k}" for k in range(2900)]
    assert got[2900:] == [f"Title {k}\n{people[k % 3]}\nclean {k}" for k in range(100)]


def test_the_number_of_pages_does_not_matter(spark):
    """Three equally common values stay on small and large hosts."""
    for n in (30, 9000):
        html = [f"<article><h2>part {k % 3}</h2><p>text {k}</p></article>" for k in range(n)]
        assert extract(spark, html) == [f"part {k % 3}\ntext {k}" for k in range(n)]


def test_pages_with_one_longest_block_are_no_copies(spark):
    """A long notice on all pages goes; pages that are equal in all their text count once."""
    notice = "<div class=legal>" + "a long notice of this site " * 9 + "</div>"
    assert extract(spark, [f"<body>{notice}<p>text {k}</p>" for k in range(12)]) == [f"text {k}" for k in range(12)]
    assert all("notice" in t for t in extract(spark, [f"<body>{notice}<p>text</p>"] * 12))


def test_importance_by_brute_force(spark):
    """What the most common content tells and the entropy of the presentation, path by path."""
    import math
    from collections import Counter

    import pytest

    html = [f"<body><nav><a>Home</a></nav><div class=t><b>{k % 4 and 'same' or k}</b>{'<i>x</i>' * (k % 3)}</div><p>text {k}</p></body>" for k in range(20)]
    want: dict = {}
    for h in html:
        blocks, styles = pages.parse(h)
        for path, content in pages.contents(blocks).items():
            one = want.setdefault(path, (Counter(), Counter()))
            one[0][content] += 1
            one[1][" ".join(styles[path])] += 1
    got = {r.path: r for r in pages.style_tree(spark.createDataFrame([("h", h) for h in html], "host string, html string")).collect()}
    assert set(got) == set(want) and len(got) == 4
    for path, (content, style) in want.items():
        n = content.total()
        entropy = -sum(c / n * math.log2(c / n) for c in style.values())
        assert got[path].pages == n and content[got[path].content] == max(content.values())
        assert got[path].importance == pytest.approx(-0.9 * math.log2(max(content.values()) / n) + 0.1 * entropy)


def test_the_tree_alone_removes_what_all_pages_share(spark):
    """Without names, roles and classes: menu, notice and footer go; so they do when the tree is not broadcast."""
    page = "<body><div class=x1><a>Home</a><a>About</a></div><div class=x2>We use cookies</div><h1>Title {0}</h1><p>text {0}</p><div class=x3>All rights</div></body>"
    rows = [(k, "http://a.example/", page.format(k)) for k in range(20)] + [(50, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (10**6, 0):
        got = {r.page_id: r.text for r in pages.extract(table, lists=False, broadcast=most).collect()}
        assert got == {k: f"Title {k}\ntext {k}" for k in range(20)} | {50: ""}
    assert "cookies" in pages.main_text(rows[0][2], lists=False)


def test_deep_pages_take_little_memory():
    """Memory grows with the page, not with its depth times its length."""
    import tracemalloc

    for html in ("<div class=aaaa>" * 100_000 + "x", "<font>" * 50_000 + "<p>a</i>" * 20_000, "<b><i>" * 50_000 + "</u>" * 50_000 + "x"):
        tracemalloc.start()
        text = pages.main_text(html)
        assert text and tracemalloc.get_traced_memory()[1] < 200e6
        tracemalloc.stop()
