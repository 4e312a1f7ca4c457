"""Scans of folders by blocks against the same scan voxel by voxel."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from planewise.functions.storage import written
from planewise.operators import scorecard as S
from planewise.sources import regions as R
from planewise.sources import tiff
from tests.test_blocks import strips
from tests.test_sources import packed_tiff, tiff_bytes


def field(rng, planes=4, high=45, wide=37):
    """Two techniques' labels and an image."""
    masks = {}
    for method in ("a", "b"):
        m = np.zeros((planes, high, wide), np.uint32)
        for label in range(1, 13):
            z, y, x = rng.integers(planes), rng.integers(high - 9), rng.integers(wide - 9)
            for k in range(z, min(planes, z + rng.integers(1, 4))):
                m[k, y : y + rng.integers(5, 9), x : x + rng.integers(5, 9)] = label * 1000
        masks[method] = m
    return masks, rng.integers(0, 3000, (planes, high, wide)).astype(np.uint16)


def folders(tmp_path, kind=np.uint16):
    rng = np.random.default_rng(8)
    for region, fov in (("r1", "f1"), ("r1", "f2"), ("r2", "f1")):
        masks, light = field(rng)
        for method, m in masks.items():
            folder = tmp_path / method / region / fov
            folder.mkdir(parents=True)
            (folder / "masks.tif").write_bytes(strips(m, 7 if method == "a" else 5))
        folder = tmp_path / "light" / region / fov
        folder.mkdir(parents=True)
        for z, plane in enumerate(light.astype(kind) if kind is np.uint16 else light.astype(kind) + kind(0.25)):
            data = packed_tiff(plane, 8, (16, 16), False) if kind is np.uint16 else tiff_bytes(plane[None])
            (folder / f"DAPI_decon_z{z + 8}.tif").write_bytes(data)
    (tmp_path / "a" / "r1" / "only_a").mkdir()
    (tmp_path / "a" / "r1" / "only_a" / "masks.tif").write_bytes(b"not read, as it has no partner")
    return {m: str(tmp_path / m) for m in ("a", "b")}, {r: str(tmp_path / "light" / r) for r in ("r1", "r2")}


def voxelwise(spark, tmp_path):
    """The same voxels as rows."""
    out = None
    for region, fov in (("r1", "f1"), ("r1", "f2"), ("r2", "f1")):
        for method in ("a", "b"):
            labels = tiff.load_volumes(spark, f"{tmp_path}/{method}/{region}/{fov}/masks.tif", "label").drop("path")
            light = tiff.load_volumes(spark, f"{tmp_path}/light/{region}/{fov}/*.tif", "brightness", single_plane=True).drop("path").withColumn("z", F.col("z") - 8)
            v = tiff.paired_voxels(labels, light).select(F.lit(region).alias("region"), F.lit(fov).alias("fov"), F.lit(method).alias("method"), "z", "y", "x", "label", "brightness")
            out = v if out is None else out.unionByName(v)
    return out


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("kind", [np.uint16, np.float32])
def test_blocks_measure_as_voxels_do(spark, tmp_path, kind):
    roots, light = folders(tmp_path, kind)
    got = R.scan_regions(spark, roots, light, target=37 * 4 * 16, area_floor=3)
    want = S.scan(written(voxelwise(spark, tmp_path)), area_floor=3)
    assert got.blocks.count() == 3 * 4 * (3 if kind is np.uint16 else 1)
    assert rows(got.areas) == rows(want.areas)
    assert rows(got.hist) == rows(want.hist)
    assert rows(got.masks) == rows(want.masks)
    assert got.dropped.count() > 0
    assert rows(R.score_folders(spark, roots, light, area_floor=3)) == rows(S.score_fovs(S.fov_metrics(want.masks, want.brightness, want.filters)))
    assert got.hist.columns == want.hist.columns


def test_regions_and_no_image(spark, tmp_path):
    roots, light = folders(tmp_path)
    assert {r.region for r in R.scan_regions(spark, roots, regions=("r2",)).masks.select("region").distinct().collect()} == {"r2"}
    assert R.score_folders(spark, roots).where("Signal is not null").count() == 0
    with pytest.raises(ValueError, match="image"):
        R.scan_regions(spark, roots).hist  # noqa: B018
    with pytest.raises(FileNotFoundError):
        R.scan_regions(spark, roots, regions=("none",))


def test_shapes_must_agree(spark, tmp_path):
    roots, light = folders(tmp_path)
    plane = tmp_path / "light" / "r2" / "f1" / "DAPI_decon_z9.tif"
    plane.write_bytes(tiff_bytes(np.zeros((1, 45, 38), np.uint16)))
    with pytest.raises(ValueError, match="r2/f1/1"):
        R.scan_regions(spark, roots, light).blocks  # noqa: B018
    plane.unlink()
    with pytest.raises(ValueError, match="r2/f1/3"):
        R.scan_regions(spark, roots, light).blocks  # noqa: B018
