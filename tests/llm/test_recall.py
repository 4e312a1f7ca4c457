"""Recall of the vector search on rows of other kinds than the given tables'."""

from __future__ import annotations

import numpy as np
import pytest

from planewise.llm import vectors

RNG = np.random.default_rng(11)


def near_copies():
    """A tight group of many more near copies than a query has answers, among rows that take up the codes."""
    x = RNG.normal(size=(3600, 64))
    x[::2] = RNG.normal(size=64) + RNG.normal(size=(1800, 64)) * 1e-3
    return x


def other_queries():
    """Rows that ask lie elsewhere than the others, which have no structure."""
    x = RNG.normal(size=(1600, 64))
    x[::20] = RNG.normal(size=(80, 64)) * 0.1 - 3.0
    return x


def long_vectors():
    """A few vectors are much longer than the others and the nearest to all."""
    return RNG.normal(size=(1600, 64)) * np.exp(RNG.normal(size=(1600, 1)) * 2)


def large_offset():
    return 1e6 + RNG.normal(size=(1600, 64))


@pytest.mark.parametrize("kind", [near_copies, other_queries, long_vectors, large_offset])
def test_recall_of_other_rows(spark, kind):
    x = kind()
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in vectors.nearest(table, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, len(x), 20))
    shares = []
    for q, found in got.items():
        score = (x * x[q]).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(len(x)), -score)) if j != q][:20]
        shares.append(len({j for _, j, _ in found} & set(order)) / 20)
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        assert all(s == pytest.approx(score[j], rel=1e-12) for _, j, s in found)
    assert np.mean(shares) >= 0.95
