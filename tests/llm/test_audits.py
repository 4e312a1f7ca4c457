"""Divergence of sources, interaction of filters and near-duplicate vectors against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from planewise.llm import divergence, interactions, tiles

DOC = "doc_id long, text string, lang string, source string, part string, rank int, value long"


def documents(spark, rows):
    """Rows of id, text, lang and source, with columns whose names the results have too."""
    return spark.createDataFrame([(*r, "part", 1, 2) for r in rows], DOC)


# divergence


def plain_divergence(rows, min_docs, top=50):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        spread = Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t, n in spread.items() if n >= min_docs), key=lambda t: t.encode())
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if spread[t] >= min_docs) for s in {d[1] for d in own}}
        every = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        p = {s: {t: share(c, t) for t in kept} for s, c in counts.items()}
        q = {t: share(every, t) for t in kept}
        for s in counts:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((q[t] - p[s][t], t) for t in kept if counts[s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out |= {(lang, s, part, item, -v, rank) for part, found in (("pair", pairs), ("term", terms)) for rank, (v, item) in enumerate(found, 1)}
    return out


def invented(n, seed=0):
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("the", "Thé", "ÉTÉ", "日本", "a", "an", "and") for b in ("", "x", "y", "é", "Z", "ab", "abc")]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60))), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "é", None, ""])) for i in range(n)]
    return [*rows, (1, None, "en", "only null"), (1, "1 2 3 @[`{\x7f", "none", "x"), (1, "", "none", "y"), (None, "the the", "en", "a"), (2, "word-" * 300_000, "en", "long"), (2, "word-" * 300_000, "en", "long")]


@pytest.mark.parametrize("min_docs", [1, 5])
def test_divergence(spark, min_docs):
    rows = invented(300)
    docs = documents(spark, rows).repartition(5)
    want = plain_divergence(rows, min_docs, top=4)
    for part_size in (1 << 20, 40):
        got = divergence.divergence(docs, min_docs=min_docs, top=4, part_size=part_size)
        assert {tuple(r) for r in got.collect()} == want
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]


def test_divergence_of_nothing(spark):
    assert divergence.divergence(documents(spark, [])).collect() == []


def test_tries_flush_and_cut(spark, monkeypatch):
    rows = invented(80)
    monkeypatch.setattr(divergence, "POUR", 500)
    monkeypatch.setattr(divergence, "LEAVES", 20)
    monkeypatch.setattr(divergence, "CHUNK", 7)
    monkeypatch.setattr(divergence, "BATCH", 3)
    batch = pa.RecordBatch.from_pydict({"text": [r[1] or "" for r in rows[:80]], "lang": [r[2] or "" for r in rows[:80]], "source": [r[3] or "" for r in rows[:80]]})
    sent = [r for b in divergence._counted(iter([batch])) for r in b.to_pylist()]
    counted = Counter()
    for r in sent:
        for s, n in zip(r["sources"], r["counts"], strict=True):
            counted[r["lang"], s, r["term"]] += n
    plain = Counter((lang or "", source or "", t) for _, text, lang, source in rows[:80] for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
    assert +counted == plain
    assert {k[:2] for k in counted if k[2] == ""} == {(r[2] or "", r[3] or "") for r in rows[:80]}


def test_trie_walks_in_byte_order():
    rng = random.Random(1)
    terms = {"".join(rng.choices("abé日", k=rng.randrange(1, 8))).encode() for _ in range(500)}
    trie = divergence.Trie()
    for t in terms:
        trie.merge(t, {"s": 1}, 1)
        trie.merge(t, {"s": 2, "o": 1}, 2)
    assert [t for t, _ in trie.walk()] == sorted(terms)
    assert trie.leaves == len(terms) and all(node.counts == {"s": 3, "o": 1} and node.docs == 3 for _, node in trie.walk())


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 5, 10**12 + 7, 9 * 10**15 - 1])
    total = np.int64(9 * 10**15)
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * int(c) // int(total) for c in counts]


def test_pairs_in_stripes(monkeypatch):
    rng = np.random.default_rng(0)
    terms, names = [f"t{i:03}" for i in range(50)], [f"s{i}" for i in range(9)]
    table = rng.integers(0, 4, (50, 9))
    where, who = np.nonzero(table)
    spread = (where, who, table[where, who])
    args = (terms, spread, names, table.sum(axis=0), int(table.sum()), 50, 3)
    want = sorted(divergence.compare(*args))
    monkeypatch.setattr(divergence, "SUMS", 20)
    monkeypatch.setattr(divergence, "TABLE", 30)
    assert sorted(divergence.compare(*args)) == want


# interactions


def plain_interactions(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts: dict = {}
    for i, text, _, source in rows:
        body = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", body)
        fails = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", body)) > 5 * len(body), bool(re.search("[#$%&*|]", body)), i is not None and first[body] < i)
        parts.setdefault(source or "", []).append((i, {c for c, f in zip("ABCDE", fails, strict=True) if f}))
    out = set()
    for part, docs in parts.items():
        orders = ["".join(p) for p in permutations("ABCDE")]
        removed = {(o, k): [(i, f) for i, f in docs if o[k] in f and not f & set(o[:k])] for o in orders for k in range(5)}
        total = {c: sum(len(removed[o, o.index(c)]) for o in orders) for c in "ABCDE"}
        for o in orders:
            for k, c in enumerate(o):
                gone = removed[o, k]
                kept = sum(not f & set(o[: k + 1]) for _, f in docs)
                redundant = sum(c in f and bool(f & set(o[:k])) for _, f in docs)
                unique = sum(f == {c} for _, f in docs)
                out.add((part, o, k + 1, kept, len(gone), redundant, unique, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), total[c]))
    return out


def test_interactions(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "One TWO", "x" * 3000, "a b " * 400_000, " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60)) + " | $", "日本 " * 60, "a\x0bb\x0cc"]
    rows = [(rng.randrange(90), rng.choice(texts), None, rng.choice(["a", "b", None, ""])) for _ in range(120)] + [(None, "one", None, "a"), (None, "one", None, "c"), (5, "one", None, "a"), (5, "one", None, "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 80, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = interactions.interactions(documents(spark, rows), frame)
    assert {tuple(r) for r in got.collect()} == plain_interactions(rows, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert interactions.interactions(documents(spark, []), frame).collect() == []
    assert interactions.interactions(documents(spark, rows[:3]), frame.limit(0)).count() == 600 * len({r[3] or "" for r in rows[:3]})


# near-duplicate vectors


def plain_links(rows, cutoff=0.98):
    sound = [v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.array(v) / np.abs(v).max() if s else None for (_, v, _), s in zip(rows, sound, strict=True)]
    unit = [None if u is None else u / np.sqrt((u * u).sum()) for u in unit]
    n = len(rows)
    link = [[j for j in range(n) if j != i and sound[i] and sound[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cutoff] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = set(link[todo.pop()]) - seen
            seen |= new
            todo += new
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(link[i]), least, rows[i][0] == least))
    return sorted(out, key=repr)


def planted(rng, n=160, dims=24):
    """Random directions, with chains of near copies around the cutoff, scaled copies and exact ones."""
    base = rng.normal(size=(12, dims))
    rows = []
    for i in range(n):
        v = base[rng.integers(12)] + rng.choice([0, 0.02, 0.15, 0.2, 0.25]) * rng.normal(size=dims)
        rows.append((int(i), [float(x) for x in v * rng.choice([1.0, 3.0, 1e-200, 1e200])], int(rng.integers(3)) if rng.random() < 0.9 else None))
    rows += [(900 + k, rows[0][1], rows[0][2]) for k in range(5)]
    rows += [(7, rows[3][1], 1), (7, [0.0] * dims, 1), (8, None, 1), (None, rows[5][1], rows[5][2]), (None, [1.0] * dims, 9), (None, [1.0] * dims, 9), (10, [float("nan")] * dims, 1)]
    return [*rows, (11, [None] * dims, 1), (12, [float("inf")] * dims, 1), (13, [1.0, 2.0], 1), (14, [2.0, 4.0], 1), (15, [], 1)]


@pytest.mark.parametrize("block", [4096, 20])
def test_near_vectors(spark, block):
    rows = planted(np.random.default_rng(5))
    frame = spark.createDataFrame([(*r, True, 1) for r in rows], "vec_id long, embedding array<double>, label int, kept boolean, n long")
    got = tiles.near_duplicates(frame, block=block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_links(rows)
    assert got.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]


def test_no_vectors(spark):
    assert tiles.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


@pytest.mark.parametrize("dims", [3, 64, 1500])
def test_bounds_hold(dims):
    """No pair at the cutoff is lost by its codes, and few others are looked at again."""
    rng = np.random.default_rng(dims)
    a = tiles.normalised(np.concatenate([rng.normal(size=(60, dims)), np.eye(dims)[:3], rng.normal(size=(20, dims)) ** 9]))
    b = tiles.normalised(a + rng.choice([0.0, 0.01, 0.1, 0.2], size=(len(a), 1)) * rng.normal(size=a.shape) / dims**0.5)
    near = tiles.maybe_near(tiles.quantised(a), tiles.quantised(b), 0.98)
    true = a @ b.T >= 0.98
    assert not (true & ~near).any() and true.any() and not near.all()
    for few in (near, near & (rng.random(near.shape) < 0.02)):
        assert (tiles.links(a, b, few, 0.98) == (true & few)).all()
