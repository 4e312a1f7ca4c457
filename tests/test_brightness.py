"""Histograms, cutoffs and scores on small voxel tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from planewise.functions.columns import KEYS
from planewise.operators import brightness as B
from planewise.operators import cutoff as X
from planewise.operators import scorecard as S

SCHEMA = "region string, fov string, method string, z int, y int, x int, label long, brightness double"


def volume(spark, values, labels, method="a"):
    return spark.createDataFrame([("r", "f", method, 0, 0, i, int(k), float(v)) for i, (v, k) in enumerate(zip(values, labels, strict=True))], SCHEMA)


def test_auc_is_the_rank_statistic(spark):
    rng = np.random.default_rng(1)
    values, labels = rng.integers(0, 30, 200), rng.integers(0, 2, 200)
    v = volume(spark, values, labels)
    got = B.auc(B.groups(B.pooled(B.histograms(v, B.bin_edges(v))), KEYS), KEYS).first().auc
    a, b = values[labels == 1], values[labels == 0]
    want = np.mean((a[:, None] > b[None, :]) + 0.5 * (a[:, None] == b[None, :]))
    assert math.isclose(got, want, rel_tol=1e-12)


def test_cdf_undoes_quantile(spark):
    rng = np.random.default_rng(2)
    v = volume(spark, rng.random(300) * 50, np.zeros(300))
    pool = B.pooled(B.histograms(v, B.bin_edges(v, n_bins=40)))
    side = (*KEYS, "masked")
    for q in (0.1, 0.5, 0.9):
        points = B.quantiles(pool, {"point": q}, side)
        assert math.isclose(B.cdf_at(pool, points, side, "share").first().share, q, rel_tol=1e-9)


def test_one_sided_and_constant_images(spark):
    all_masked = B.brightness_stats(B.histograms(v := volume(spark, [1, 2, 3], [1, 1, 1]), B.bin_edges(v))).first()
    assert all_masked.separability is None and all_masked.median_unmasked is None and all_masked.frac_masked == 1
    flat = volume(spark, [0.5] * 4, [0, 0, 1, 1])
    stats = B.brightness_stats(B.histograms(flat, B.bin_edges(flat))).first()
    assert stats.separability == 0.5 and stats.point_biserial_r is None


def test_cutoff_sides(spark):
    v = volume(spark, [6999, 7000, 7001, 10], [1, 1, 1, 0])
    rows = {r.group: r for r in X.cutoff_within(B.pooled(B.histograms(v, B.bin_edges(v)))).collect()}
    assert math.isclose(rows["masked"].auc_below, 1 / 3) and rows["unmasked"].pct_below == 100.0
    two = volume(spark, [1, 2, 3, 4], [1, 1, 1, 1]).unionByName(volume(spark, [1, 2, 3, 4], [1, 1, 1, 1], "b"))
    pair = X.cutoff_across(B.pooled(B.histograms(two, B.bin_edges(two))), 3.0).first()
    assert (pair.method_a, pair.method_b, pair.d_pct_above, pair.auc_below, pair.auc_above) == ("a", "b", 0.0, 0.5, 0.5)


def test_score_takes_missing_lines_out(spark):
    row = spark.createDataFrame([("r", "f", "m", 10.0, 20.0, None, None)], "region string, fov string, method string, pct_thin double, pct_jittery double, pct_swayed double, separability double")
    got = S.score_fovs(row).first()
    assert got.Sway is None and got.Signal is None
    assert math.isclose(got.Total, (0.9 * 0.10 + 0.8 * 0.50) / 0.60)
    assert S.score_fovs(row, {"Signal": 1.0}).first().Total is None
    assert math.isclose(S.score_fovs(row.withColumn("pct_thin", F.lit(200.0)), {"Span": 1.0}).first().Total, -1.0)
