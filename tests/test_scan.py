"""Labels of a scan come from one pass over their planes, and its voxels are neither dealt out by image nor read twice over for few dropped labels."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from planewise.operators import areas as A
from planewise.operators import brightness as B
from planewise.operators import profile as P
from planewise.operators import scorecard as S

VOXEL = "region string, fov string, method string, z int, label bigint, brightness double"
KEYS = ("region", "fov", "method")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def voxels(spark):
    """Labels of gaps, slivers and single planes, the same in all fields, among background of every kind."""
    draw = random.Random(5)
    out = []
    for n, (fov, method) in enumerate([("f", "a"), ("f", "b"), ("g", "a"), ("g", "b")]):
        for label in range(1, 40):
            for z in sorted(draw.sample(range(12), draw.choice((1, 1, 2, 5, 9)))):
                out += [("r", fov, method, z, label, float(draw.randrange(20)))] * draw.choice((1, 2, 3, 40))
        out += [("r", fov, method, z, b, float(20 + n + z)) for z in range(12) for b in (0, 0, None, -1)]
    return spark.createDataFrame(out, VOXEL).repartition(5)


@pytest.mark.parametrize("how", [{}, {"drop": False}, {"drop_in": ("b",)}, {"area_floor": 1, "sliver_frac": 0.2}])
def test_measures_are_those_of_the_masks(voxels, how):
    s = S.scan(voxels, **how)
    shared = [c for c in s.measures.columns if c in s.masks.columns]
    assert {"thin", "deep", "has_z_gap", "z_span", "jitter", "sway", "n_reversals", "large_jitter", "large_sway"} <= set(shared)
    got = rows(s.measures, shared)
    assert got == rows(s.masks, shared) and len(got) > 50
    assert rows(s.dropped, [*KEYS, "label"]) == rows(A.single_slice(s.spans, s.drop, s.drop_in), [*KEYS, "label"])
    assert rows(s.filters, ["method", "n_total", "n_dropped"]) == rows(A.filter_report(s.spans, s.drop, s.drop_in), ["method", "n_total", "n_dropped"])
    assert rows(s.edges, ["fov", "lo", "width", "n_bins", "exact"]) == rows(B.bin_edges(voxels), ["fov", "lo", "width", "n_bins", "exact"])


def test_a_label_is_measured_by_one_sort_and_one_pass(spark, voxels):
    s = S.scan(voxels)
    assert not re.search(r"Exchange|Join|Window", plan(s.measures))
    assert "planes" not in vars(s)  # nothing listed planes
    found = plan(P.measured_labels(s.planes))
    assert len(re.findall(r"\bSort \[", found)) == 1 and len(re.findall(r"\bWindow \[", found)) == 1 and len(re.findall(r"\bExchange\b", found)) == 1
    assert len(re.findall(r"\bWindow \[", plan(P.profiles(s.areas)))) == 1


def test_voxels_are_not_dealt_out_by_image(spark, voxels):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # edges are smaller, what they are counted from is larger
    try:
        found = plan(B.histograms(voxels, B.bin_edges(voxels)))
        assert "BroadcastHashJoin [region" in found and "SortMergeJoin" not in found
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("few", [0, 1_500_000])
def test_few_and_many_dropped_labels(voxels, monkeypatch, few):
    monkeypatch.setattr(S, "FEW_DROPPED", few)
    s = S.scan(voxels)
    assert s.dropped.count() > 0
    kept = A.drop_labels(voxels, s.dropped, few=bool(few))
    assert ("Union" in plan(kept)) is not bool(few)
    assert kept.columns == voxels.columns
    gone = {tuple(r) for r in s.dropped.collect()}
    want: dict[tuple, int] = {}
    for r in voxels.collect():
        key = (r.region, r.fov, r.method, (r.label or 0) > 0 and (r.region, r.fov, r.method, r.label) not in gone)
        want[key] = want.get(key, 0) + 1
    got = s.hist.where("masked is not null").groupBy(*KEYS, "masked").agg(F.sum("n").alias("n"))
    nulls = sum(r.n for r in s.hist.where("masked is null").collect())
    assert nulls == 4 * 12
    got = {tuple(r)[:4]: r.n + (12 if not r.masked else 0) for r in got.collect()}  # a null label is of neither kind
    assert got == want


def test_numbers_stand_for_segmentations(spark, voxels):
    """No name of a segmentation is shuffled, sorted or counted with its voxels and planes."""
    s = S.scan(voxels)
    for df in (A.plane_areas(s.numbered(), (S.SEG,)), P.measured_labels(A.plane_areas(s.numbered(), (S.SEG,)), keys=(S.SEG,))):
        shuffles = re.findall(r"hashpartitioning\((.*)", plan(df))
        assert shuffles and all(S.SEG in x and not re.search("region|fov|method", x) for x in shuffles)
    edges = s.named.join(s.edges, ["region", "fov"])
    found = plan(B.histograms(A.drop_labels(s.numbered(), spark.createDataFrame([(1, 1)], f"{S.SEG} bigint, label bigint"), (S.SEG,), True), edges, (S.SEG,), (S.SEG,)))
    counted = re.search(r"hashpartitioning\((.*)", found).group(1)
    assert S.SEG in counted and not re.search("region|fov|method|lo#|width|exact", counted)


def test_names_that_are_null_or_run_together(spark, voxels):
    """A null is a name of its own, and names are told apart by where they end; so are labels that lie in one of them only."""
    names = [(None, "f", "a"), ("f", None, "a"), ("f", "a", None), (None, None, None), ("", "f", "a"), ("r", "fa", ""), ("rf", "a", ""), ("r", "f", "a")]
    data = [(*n, z, label, float(z + i)) for i, n in enumerate(names) for z in range(4) for label in (0, i + 1) for _ in range(1 + (z + i) % 3)] + [(*n, 2, 50, 1.0) for n in names[::2]]
    v = spark.createDataFrame(data, VOXEL)
    s = S.scan(v, area_floor=1)
    planes: dict[tuple, set[int]] = {}
    for region, fov, method, z, label, _ in data:
        if label > 0:
            planes.setdefault((region, fov, method, label), set()).add(z)
    got = {(r.region, r.fov, r.method, r.label): (r.z_start, r.z_span) for r in s.labels.collect()}
    assert got == {k: (min(p), max(p) - min(p) + 1) for k, p in planes.items()}
    assert {(r.region, r.fov, r.method) for r in s.named.collect()} == set(names)
    gone = {(*n, 50) for n in names[::2]}
    assert {tuple(r) for r in s.dropped.select(*KEYS, "label").collect()} == gone
    hist = {tuple(r) for r in s.hist.groupBy(*KEYS, "masked").agg(F.sum("n")).collect()}
    want: dict[tuple, int] = {}
    for region, fov, method, _, label, _ in data:
        if region is not None and fov is not None:  # no image without a name; a label without a technique's name is not joined
            dropped = method is not None and (region, fov, method, label) in gone
            want[region, fov, method, label > 0 and not dropped] = want.get((region, fov, method, label > 0 and not dropped), 0) + 1
    assert hist == {(*k, n) for k, n in want.items()}


def test_numbers_that_two_segmentations_share_are_given_up(voxels, monkeypatch):
    number = S.number_of
    monkeypatch.setattr(S, "number_of", lambda keys, salt=0: F.pmod(number(keys, salt), F.lit(1 if salt < 2 else 1 << 62)))
    s = S.scan(voxels)
    assert s.salt == 2
    shared = [c for c in s.measures.columns if c in s.masks.columns]
    assert rows(s.measures, shared) == rows(s.masks, shared)
    assert s.hist.select("fov", "method").distinct().count() == 4


def test_background_is_not_searched_among_few_dropped_labels(spark, voxels):
    listed = spark.createDataFrame([("r", "f", "a", 1), ("r", "f", "a", -1), ("r", "f", "a", 0)], "region string, fov string, method string, label bigint")
    kept = A.drop_labels(voxels, listed, few=True)
    assert "BroadcastHashJoin [_label" in plan(kept)
    want = A.drop_labels(voxels, listed)
    assert rows(kept.groupBy(*KEYS, "label").count(), [*KEYS, "label", "count"]) == rows(want.groupBy(*KEYS, "label").count(), [*KEYS, "label", "count"])
