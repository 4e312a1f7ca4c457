"""Small profiles with known answers, random ones against a dense restatement, and invariants."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from planewise.operators import areas as A
from planewise.operators import change as C
from planewise.operators import profile as P

CASES = {
    "constant": ([100, 100, 100, 100], 1, 1, 0, -1),
    "growth": ([100, 200, 400, 800], 1, 1, 0, -1),
    "step10": ([100, 100, 1000, 1000], 1, 10, 0, -1),
    "step20": ([100, 100, 2000, 2000], 1, 20, 0, -1),
    "step21": ([100, 100, 2100, 2100, 2100], 1, 1, 0, -1),
    "reversal": ([100, 200, 100], 2, 4, 1, 1),
    "tie": ([100, 200, 100, 200, 100], 8, 4, 3, 1),
    "flat": ([100, 100, 50], 1, 2, 0, -1),
    "two": ([100, 120], None, None, 0, -1),
    "gap": ([100, 100, 0, 100, 100], None, None, 0, -1),
    "floor": ([10, 100, 100, 100], 1, 1, 0, -1),
}


def table(spark, profiles):
    rows = [("r", "f", "m", k + 1, z, a) for k, p in enumerate(profiles) for z, a in enumerate(p) if a > 0]
    return spark.createDataFrame(rows, "region string, fov string, method string, label long, z int, area long")


def test_known_profiles(spark):
    names = list(CASES)
    got = {r.label: r for r in P.profiles(table(spark, [CASES[n][0] for n in names])).collect()}
    for k, n in enumerate(names):
        _, jitter, sway, reversals, place = CASES[n]
        r = got[k + 1]
        for value, want in ((r.jitter, jitter), (r.sway, sway)):
            assert (value is None) == (want is None), n
            assert want is None or math.isclose(value, want, rel_tol=1e-9), n
        assert (r.n_reversals, r.z_at_jitter) == (reversals, place), n
    assert got[names.index("step10") + 1].z_at_sway == 1
    assert got[names.index("two") + 1].z_at_sway == -1
    assert (got[names.index("floor") + 1].n_planes, got[names.index("floor") + 1].n_planes_used) == (4, 3)


def test_spans_and_filter(spark):
    areas = table(spark, [[0, 50, 0], [100, 100, 0, 100, 100]])
    spans = {r.label: r for r in A.span_table(areas).collect()}
    assert (spans[1].z_span, spans[1].has_z_gap) == (1, False)
    assert (spans[2].z_span, spans[2].n_planes, spans[2].has_z_gap) == (5, 4, True)
    assert [r.label for r in A.single_slice(A.span_table(areas)).collect()] == [1]
    off = A.filter_report(A.span_table(areas), drop=False).first()
    assert (off.n_dropped, off.pct_dropped) == (0, 50.0)


def test_change_is_strict_and_floored(spark):
    changes = C.area_change(table(spark, [[100, 200], [100, 100]]))
    got = {r.label: r for r in changes.collect()}
    assert got[1].abs_frac_change == 1.0
    assert math.isclose(got[2].log_change, math.log10(0.005))
    assert not any(r.large_area_change for r in C.object_outliers(changes).collect())
    with pytest.raises(ValueError):
        C.object_outliers(changes, statistic="median")


def dense(matrix, floor, frac):
    """Jitter, sway and reversals of each row, plane by plane."""
    out = []
    for row in matrix:
        keep = [a > 0 and a >= floor and a >= frac * max(row) for a in row]
        la = [math.log10(a) if a else 0.0 for a in row]
        corners, depths = [], []
        for z in range(1, len(row) - 1):
            if keep[z - 1] and keep[z] and keep[z + 1]:
                d0, d1 = la[z] - la[z - 1], la[z + 1] - la[z]
                corners.append(abs(d1 - d0))
                if d0 * d1 < 0:
                    depths.append(min(abs(d0), abs(d1)))
        out.append((10 ** sum(depths) if corners else None, 10 ** max(corners) if corners else None, len(depths)))
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_random_profiles(spark, partitions):
    rng = np.random.default_rng(3)
    matrix = (rng.integers(0, 60, (40, 9)) * (rng.random((40, 9)) > 0.2)).tolist()
    matrix = [[int(a) for a in row] for row in matrix if any(row)]
    got = {r.label: r for r in P.profiles(table(spark, matrix).repartition(partitions)).collect()}
    for k, (jitter, sway, n) in enumerate(dense(matrix, 20, 0.05)):
        r = got[k + 1]
        assert r.n_reversals == n
        for value, want in ((r.jitter, jitter), (r.sway, sway)):
            assert (value is None) == (want is None)
            assert want is None or math.isclose(value, want, rel_tol=1e-9)


def test_empty(spark):
    none = table(spark, [[1]]).where(F.lit(False))
    assert P.profiles(none).collect() == [] and A.span_table(none).collect() == []
    assert P.flag_sway(P.profiles(none)).collect() == []
