"""Volumes written and read back; a failed job leaves nothing."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from planewise.sources import regions as R
from planewise.sources import tiff
from planewise.sources import volumes as W
from planewise.sources.blocks import open_volumes, voxels_of
from tests.test_regions import folders


def planes_of(folder):
    out = {}
    for base, _, names in os.walk(folder):
        for name in names:
            with open(f"{base}/{name}", "rb") as f:
                (page,) = tiff.planes(f.read())
            out[os.path.relpath(base, folder), int(name[1:6])] = page
    return out


def test_voxels_round_trip(spark, tmp_path):
    rng = np.random.default_rng(6)
    labels = {("r", "f", m): rng.integers(0, 3, (4, 700, 900)) * rng.integers(0, 70_000) for m in "ab"}
    rows = [(*k, int(z), int(y), int(x), int(v[z, y, x])) for k, v in labels.items() for z, y, x in np.argwhere(v)[::211]]
    voxels = spark.createDataFrame(rows, "region string, fov string, method string, z int, y int, x int, label long").repartition(5)
    W.write_voxels(voxels, f"{tmp_path}/out", shape=(700, 900))
    got = planes_of(tmp_path / "out")
    want = {k: np.zeros((700, 900), np.uint32) for k in {("/".join(r[:3]), r[3]) for r in rows}}
    for r in rows:
        want["/".join(r[:3]), r[3]][r[4], r[5]] = r[6]
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want)
    back = voxels_of(open_volumes(spark, f"{tmp_path}/out/r/f/a", pathGlobFilter="*.tif", zInName="true")).where("label > 0")
    assert {(r.z, r.y, r.x, r.label) for r in back.collect()} == {r[3:] for r in rows if r[2] == "a"}
    with pytest.raises(Exception, match="out"):
        W.write_voxels(voxels, f"{tmp_path}/out")
    assert planes_of(tmp_path / "out").keys() == want.keys()
    W.write_voxels(voxels.where("z = 1"), f"{tmp_path}/out", overwrite=True)
    assert {z for _, z in planes_of(tmp_path / "out")} == {1}
    assert os.listdir(tmp_path) == ["out"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    voxels = spark.range(60).select(F.lit("r").alias("region"), F.lit("f").alias("fov"), F.lit("m").alias("method"), (F.col("id") % 6).cast("int").alias("z"), (F.col("id") % 5).cast("int").alias("y"), F.lit(0).alias("x"), F.col("id").alias("label"))
    with pytest.raises(Exception, match="out of bounds"):
        W.write_voxels(voxels.withColumn("x", F.when(F.col("z") == 3, 99).otherwise(0)), f"{tmp_path}/out", shape=(9, 9))
    assert os.listdir(tmp_path) == []


def test_kept_volumes_of_a_scan(spark, tmp_path):
    roots, light = folders(tmp_path / "in")
    s = R.scan_regions(spark, roots, target=37 * 4 * 16, area_floor=3)
    W.write_kept(s, f"{tmp_path}/kept")
    W.write_kept(s, f"{tmp_path}/gone", dropped=True)
    dropped = {}
    for r in s.dropped.collect():
        dropped.setdefault(f"{r.region}/{r.fov}/{r.method}", set()).add(r.label)
    kept, gone = planes_of(tmp_path / "kept"), planes_of(tmp_path / "gone")
    seen = 0
    for m, root in roots.items():
        for region, fov in (("r1", "f1"), ("r1", "f2"), ("r2", "f1")):
            name = f"{region}/{fov}/{m}"
            with open(f"{root}/{region}/{fov}/masks.tif", "rb") as f:
                for z, page in enumerate(tiff.planes(f.read())):
                    hit = np.isin(page, list(dropped.get(name, ())))
                    seen += hit.any()
                    assert np.array_equal(kept[name, z], np.where(hit, 0, page)) and np.array_equal(gone[name, z], np.where(hit, page, 0))
    assert seen and kept[name, 0].dtype == np.uint32
