from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from planewise.operators import inference as I
from planewise.operators import ranks as R

SCHEMA = "region string, fov string, metric string, diff double"


def frame(spark, metrics):
    return spark.createDataFrame([("r", f"f{k:06}", m, float(v)) for m, d in metrics.items() for k, v in enumerate(d)], SCHEMA).repartition(4)


def average_ranks(size):
    _, inverse, counts = np.unique(size, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[inverse]


def test_signed_rank_exact():
    d = np.array([1.0, -2.0, 3.5, 4.0, 5.0, -6.0, 7.0])
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    up = ranks[d > 0].sum()
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    low = min(up, ranks.sum() - up)
    assert math.isclose(I.signed_rank_p(7, 7, up, 0, 0), min(1.0, 2 * np.mean(np.array(sums) <= low)))
    assert I.signed_rank_p(0, 0, 0, 0, 4) is None
    assert 0 < I.signed_rank_p(4, 2, 6.0, 24, 1) <= 1


METRICS = {
    "ties": np.array([1.0, 1.0, -1.0, 2.0, 0.0, -2.0, 2.0, 3.0] * 9),
    "plain": np.random.default_rng(2).normal(0.3, 1, 137),
    "wide": np.random.default_rng(3).normal(size=90) * 10.0 ** np.random.default_rng(4).integers(-8, 8, 90),
    "zeros": np.zeros(6),
    "one": np.array([-4.0]),
    "two": np.array([1.0, 4.0]),
    "signs": np.concatenate([np.full(70, -1.5), np.full(71, 1.5)]),
}


@pytest.mark.parametrize("parts", [1, 6])
def test_signed_ranks(spark, parts):
    got = {r.metric: r for r in R.signed_ranks(frame(spark, METRICS), parts).collect()}
    for m, d in METRICS.items():
        d = d[d != 0]
        if not len(d):
            assert m not in got
            continue
        ranks = average_ranks(np.abs(d))
        _, counts = np.unique(np.abs(d), return_counts=True)
        want = (len(d), len(counts), ranks[d > 0].sum(), ranks[d < 0].sum(), (counts**3 - counts).sum())
        assert (got[m].n, got[m].n_sizes, got[m].up, got[m].down, got[m].ties) == want


@pytest.mark.parametrize("block", [1 << 16, 8])
def test_hodges_lehmann(spark, block):
    """Against all pairs, in one task and by the search over blocks."""
    got = {r.metric: r.hl_shift for r in R.hodges_lehmann(frame(spark, METRICS), 3, block).collect()}
    for m, d in METRICS.items():
        i, j = np.triu_indices(len(d))
        assert got[m] == pytest.approx(np.median((d[i] + d[j]) / 2), rel=1e-12, abs=1e-300)
    assert R.hodges_lehmann(frame(spark, METRICS).limit(0)).collect() == []


def test_search_of_many_differences(spark):
    """Half a million differences: two billion pairs of blocks' values, none of which becomes a row."""
    table = spark.range(500_000).selectExpr("'m' as metric", "cast((id * 7919 % 500009) as double) / 500009 - 0.25 as diff")
    d = np.sort((np.arange(500_000) * 7919 % 500009) / 500009 - 0.25)
    got = R.hodges_lehmann(table, 4, 1 << 15).first().hl_shift
    n = len(d)
    at = np.searchsorted(d, 2 * got - d, "right")
    under = np.searchsorted(d, np.nextafter(2 * got, -1) - d, "right")
    half = (n * (n + 1) // 2) // 2
    assert (int(under.sum()) - n) / 2 <= half + n and (int(at.sum()) + n) / 2 >= half - n
    assert got == pytest.approx(0.25, abs=1e-5)


@pytest.mark.parametrize("draws", [1 << 24, 2000, 1])
def test_draws_are_those_of_one_generator(spark, draws):
    """However many tasks make them."""
    got = {r.metric: (r.ci_lo, r.ci_hi) for r in R.bootstrap_intervals(frame(spark, {**METRICS, "bad": np.array([1.0, np.nan, np.inf])}), "metric", ("region", "fov"), "diff", 60, seed=5, draws=draws).collect()}
    assert set(got) == set(METRICS) - {"one"}
    for m in got:
        d = METRICS[m]
        want = np.quantile(np.median(np.random.default_rng(5).choice(d, size=(60, len(d))), axis=1), [0.025, 0.975])
        assert got[m] == pytest.approx(tuple(want), rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("n", [2, 3, 25, 4096, 2**31 + 5, 3 * 10**9])
def test_numbers_that_are_no_draws(n):
    want = np.random.default_rng(7).integers(0, n, size=6000)
    parts, over = [], 0
    for first in range(0, 14_000, 701):
        parts.append(R.accepted(7, first, 701, n))
        over += R.passed_over(7, first, 701, n, 100)
    got = np.concatenate(parts)
    assert np.array_equal(got[:6000], want) and len(got) + over == 20 * 701


def test_resamples_after_numbers_passed_over(monkeypatch):
    """A generator that passes over nearly half of its numbers, as it does for very many values."""
    plain = R.accepted
    values = np.random.default_rng(1).normal(size=9)
    monkeypatch.setattr(R, "accepted", lambda seed, first, size, n: plain(seed, first, size, 2**31 + 5) % n)
    stream = R.accepted(3, 0, 20_000, 9)[: 100 * 9].reshape(100, 9)
    want = np.median(values[stream], axis=1)
    for rows in (100, 7, 1):
        over = [rows * 9 - len(R.accepted(3, r * 9, rows * 9, 9)) for r in range(0, 100, rows)]
        got = np.concatenate([R.medians(values, 3, r, min(rows, 100 - r), sum(over[:k])) for k, r in enumerate(range(0, 100, rows))])
        assert np.array_equal(got, want)


def test_identical_techniques(spark):
    rows = [("r", f"f{k}", m, float(k)) for k in range(6) for m in "ab"] + [("r", "alone", "a", 9.0)]
    table = spark.createDataFrame(rows, "region string, fov string, method string, Total double")
    got = I.compare_techniques(table, "a", "b", ("Total",), n_boot=200).first()
    assert (got.n_pairs, got.median_diff, got.hl_shift, got.better) == (6, 0.0, 0.0, "")
    assert (got.ci_lo, got.ci_hi) == (0.0, 0.0)
    assert got.p_wilcoxon is None and got.rank_biserial is None


def test_direction(spark):
    rows = [("r", f"f{k}", m, float(k) + (m == "b") * (k + 1)) for k in range(6) for m in "ab"]
    table = spark.createDataFrame(rows, "region string, fov string, method string, pct_thin double")
    got = I.compare_techniques(table, "a", "b", ("pct_thin",), n_boot=200).first()
    assert got.median_diff > 0 and got.better == "a" and got.rank_biserial == 1.0
    assert math.isclose(got.p_wilcoxon, 2 / 2**6)


def test_summary_of_techniques(spark):
    rows = [("r", f"f{k}", m, float(k) if k else None, 2.0) for k in range(6) for m in "ab"] + [("r", "x", "c", None, 1.0)]
    table = spark.createDataFrame(rows, "region string, fov string, method string, Span double, Total double")
    got = {r.method: r for r in I.technique_summary(table, ("Span", "Total"), 300).collect()}
    low, high = np.quantile(np.median(np.random.default_rng(0).choice(np.arange(1.0, 6.0), size=(300, 5)), axis=1), [0.025, 0.975])
    assert tuple(got["a"]) == ("a", 6, 3.0, f"[{low:.2f}, {high:.2f}]", 2.0, "[2.00, 2.00]")
    assert tuple(got["c"]) == ("c", 1, None, "–", 1.0, "–")
