"""Joins of voxels with labels: what is background does not take part, and labels sort before the names of their segmentation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from planewise.operators import areas as A
from planewise.operators import cutoff as X
from planewise.operators import profile as P

VOXEL = "region string, fov string, method string, z int, label bigint, brightness double"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_background_is_not_joined(spark):
    rows = [("r", "f", "a", z, k, float(z + (k or 0))) for z in range(4) for k in (0, 0, 0, 1, 2, None, -1)] + [("r", "f", "a", 0, 3, 1.0)]
    voxels = spark.createDataFrame(rows, VOXEL)
    areas = A.plane_areas(voxels)
    dropped = A.single_slice(A.span_table(areas))
    masks = P.mask_table(A.thin_and_deep(A.span_table(areas)), P.profiles(areas, 1)).where("z_span > 1")
    hist = spark.createDataFrame([("r", "f", "a", 0, m, b, 0.0, 1.0, True, 1) for m in (True, False) for b in range(6)], "region string, fov string, method string, z int, masked boolean, bin bigint, lo double, width double, exact boolean, n bigint")
    kept = A.drop_labels(voxels, dropped)
    layers = X.defect_layers(voxels, masks, dropped, hist)
    assert sorted(str(r.label) for r in kept.collect()) == sorted(["0"] * 13 + ["1"] * 4 + ["2"] * 4 + ["None"] * 4 + ["-1"] * 4)
    # the median of both histograms is 3
    want = {("bright_unmasked", 0): 3, ("bright_unmasked", -1): 0, ("dim_masked", 1): 3, ("dim_masked", 2): 2, ("dropped", 3): 1, ("thin", 3): 0}
    got = {(r.layer, r.label): r.n for r in layers.groupBy("layer", "label").agg(F.count("*").alias("n")).collect()}
    assert {k: got.get(k, 0) for k in want} == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (A.drop_labels(voxels, dropped), X.defect_layers(voxels, masks, dropped, hist), X.flag_layers(voxels, masks, ("region", "fov", "method"))):
            joins = re.findall(r"SortMergeJoin \[(\w+)#", plan(df))
            assert "label" in joins
        assert "Union" in plan(A.drop_labels(voxels, dropped))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_planes_are_sorted_once(spark):
    """The largest plane of a label and its neighbours come from windows of one order."""
    areas = spark.createDataFrame([("r", "f", "a", 1, 0, 5)], "region string, fov string, method string, label bigint, z int, area bigint")
    assert len(re.findall(r"\bSort \[", plan(P.profiles(areas)))) == 1
