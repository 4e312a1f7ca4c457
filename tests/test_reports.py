"""Files to tables, against the same operators over voxels as rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from planewise.functions.storage import written
from planewise.operators import areas as A
from planewise.operators import brightness as B
from planewise.operators import change as C
from planewise.operators import cutoff as X
from planewise.operators import profile as P
from planewise.sources import reports as O
from planewise.sources import tiff
from tests.test_regions import folders, rows


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    return folders(tmp_path_factory.mktemp("folders"))


def one(spark, roots, light):
    """Paths of one field and its voxels."""
    masks = {m: f"{root}/r1/f1/masks.tif" for m, root in roots.items()}
    image = f"{light['r1']}/f1/*.tif"
    parts = []
    for m, path in masks.items():
        pair = tiff.paired_voxels(tiff.load_volumes(spark, path, "label").drop("path"), tiff.load_volumes(spark, image, "brightness", single_plane=True).drop("path").withColumn("z", F.col("z") - 8))
        parts.append(pair.select(F.lit("").alias("region"), F.lit("").alias("fov"), F.lit(m).alias("method"), "z", "y", "x", "label", "brightness"))
    return masks, image, written(parts[0].unionByName(parts[1]))


def test_reports_of_a_field(spark, files, tmp_path):
    masks, image, v = one(spark, *files)
    areas = A.plane_areas(v)
    spans = O.span_report(spark, masks)
    assert rows(spans["labels"]) == rows(A.check_z_span(areas))
    assert {(r.method, r.n) for r in spans["summary"].collect()} == {("a", len({r.label for r in areas.where("method = 'a'").collect()})), ("b", len({r.label for r in areas.where("method = 'b'").collect()}))}
    sway = O.sway_report(spark, masks, sway_cutoff=None, area_floor=3)
    assert rows(sway["jitter"]) == rows(P.flag_jitter(P.profiles(areas, 3)))
    assert rows(sway["sway"]) == rows(P.flag_sway(P.profiles(areas, 3)))
    assert sway["sway_quiet"].count() == min(80, sway["sway"].where("not large_sway").count())
    assert sway["jitter_worst"].count() > 0 and {r.method for r in sway["sway_summary"].collect()} == {"a", "b"}
    change = O.change_report(spark, masks)
    assert rows(change["changes"]) == rows(C.area_change(areas))
    assert change["labels"].where("large_area_change is null").count() == 0
    assert change["labels"].count() == spans["labels"].count()
    hist = B.histograms(v, B.bin_edges(v))
    light = O.brightness_report(spark, masks, image)
    assert rows(light["per_z"]) == rows(B.summarise_by_z(hist))
    assert rows(light["pooled"]) == rows(B.summarise_pooled(hist))
    kept = A.filter_single_slice(v, areas)[0]
    cut = O.cutoff_report(spark, masks, image, 1500)
    within, across = X.cutoff_report(B.histograms(kept, B.bin_edges(v)), 1500)
    assert rows(cut["within"]) == rows(within) and rows(cut["across"]) == rows(across)
    O.save_tables({"within": cut["within"]}, f"{tmp_path}/cut")
    assert spark.read.option("header", True).csv(f"{tmp_path}/cut_within").count() == 4
    with pytest.raises(Exception, match="exists"):
        O.save_tables({"within": cut["within"]}, f"{tmp_path}/cut")


def test_report_of_regions(spark, files):
    out = O.region_report(spark, *files, n_boot=50, area_floor=3)
    assert out["scores"].count() == 6 and out["metrics"].count() == 6
    got = {r.metric: r for r in out["comparison"].collect()}
    assert {"Span", "Total", "n_masks", "separability"} <= set(got) and got["Total"].n_pairs == 3
    scores = {(r.region, r.fov, r.method): r.Total for r in out["scores"].collect()}
    diffs = [scores[r, f, "b"] - scores[r, f, "a"] for r, f in (("r1", "f1"), ("r1", "f2"), ("r2", "f1"))]
    assert got["Total"].median_diff == pytest.approx(np.median(diffs))
    assert {r.method: r.n_fovs for r in out["summary"].collect()} == {"a": 3, "b": 3}
    assert {r.method for r in out["brightness"].collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="masks"):
        O.span_report(spark, {})
