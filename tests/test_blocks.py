"""Reading of volumes by blocks."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import datasource as D

from planewise.sources import blocks as K
from planewise.sources.tiff import pages, rows_of
from tests.test_sources import packed_tiff, tiff_bytes


def strips(volume: np.ndarray, rows: int) -> bytes:
    """A file of several strips for each page, of 64-bit offsets."""
    out = bytearray(b"II" + struct.pack("<HHHQ", 43, 8, 0, 0))
    link = 8
    for page in volume:
        places = []
        for y in range(0, len(page), rows):
            data = page[y : y + rows].tobytes()
            places.append((len(out), len(data)))
            out += data
        lists = []
        for values in zip(*places, strict=True):
            lists.append(len(out))
            out += struct.pack(f"<{len(values)}Q", *values)
        n = len(places)
        ends = lists if n > 1 else places[0]
        struct.pack_into("<Q", out, link, len(out))
        tags = [(256, 4, 1, page.shape[1]), (257, 4, 1, page.shape[0]), (258, 3, 1, page.dtype.itemsize * 8), (259, 3, 1, 1), (273, 16, n, ends[0]), (278, 4, 1, rows), (279, 16, n, ends[1]), (339, 3, 1, 3 if page.dtype.kind == "f" else 1)]
        out += struct.pack("<Q", len(tags))
        for tag, kind, size, value in tags:
            out += struct.pack("<HHQQ", tag, kind, size, value)
        link = len(out)
        out += struct.pack("<Q", 0)
    return bytes(out)


@pytest.mark.parametrize(("tile", "compression", "predictor"), [(None, 1, 1), (None, 8, 2), ((16, 16), 1, 1), ((16, 32), 8, 2)])
def test_rows_of_a_page(tile, compression, predictor):
    page = np.random.default_rng(1).integers(0, 999, (45, 70)).astype(np.uint16)
    data = packed_tiff(page, compression, tile, True, predictor)
    taken = []

    def fetch(at, n):
        taken.append(n)
        return data[at : at + n]

    (held,) = pages(K.windowed(fetch))
    assert len(taken) <= 2
    for y, rows in ((0, 45), (3, 1), (13, 20), (44, 9)):
        taken.clear()
        assert np.array_equal(rows_of(fetch, held, y, rows), page[y : y + rows])
        part, at = K.trimmed(held, y, rows)
        assert np.array_equal(rows_of(fetch, part, at, rows), page[y : y + rows])
        assert sum(taken) <= 2 * (rows + 32) * 96 * 2


def test_one_plane_of_a_large_volume(spark, tmp_path):
    """A volume of 5 GB with a hole for most of it: one plane is planned and read, whatever lies before it."""
    path, high, wide, planes = f"{tmp_path}/large.tif", 4096, 16384, 20  # 256 MB a plane
    with open(path, "wb") as f:
        f.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, 16))
        for z in range(planes):
            begin = f.tell()
            data = 4096 + z * (high * wide * 4 + 4096)
            tags = [(256, 4, wide), (257, 4, high), (258, 3, 32), (259, 3, 1), (273, 16, data), (278, 4, high), (279, 16, high * wide * 4), (339, 3, 1)]
            at = data + high * wide * 4 if z < planes - 1 else 0
            f.write(struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", t, k, 1, v) for t, k, v in tags) + struct.pack("<Q", at))
            if z == 17:
                f.seek(data + 4 * (5 * wide + 9))
                f.write(struct.pack("<I", 77))
            f.seek(at or begin)
        f.truncate(4096 + planes * (high * wide * 4 + 4096))
    reader = K.VolumeReader({"path": path})
    assert list(reader.pushFilters([D.EqualTo(("z",), 17), D.GreaterThan(("rows",), 0)])) == [D.GreaterThan(("rows",), 0)]
    planned = reader.partitions()
    assert {b.z for b in planned} == {17} and sum(b.rows for b in planned) == high
    # a plain page of one strip is cut all the same
    assert len(planned) == 32 and planned[1].y == 128
    got = [np.frombuffer(b.column(6)[0].as_buffer(), "<u4").reshape(-1, wide) for p in planned for b in reader.read(p)]
    assert got[0][5, 9] == 77 and sum(map(np.count_nonzero, got)) == 1


def test_source_reads_what_filters_leave(spark, tmp_path):
    volume = np.random.default_rng(2).integers(0, 9, (5, 40, 30)).astype(np.uint32)
    (tmp_path / "a").mkdir()
    for name in ("a/masks.tif", "a/other.tif"):
        (tmp_path / name).write_bytes(strips(volume, 8))
    blocks = K.open_volumes(spark, f"{tmp_path}/a", pathGlobFilter="masks.tif", blockBytes=8 * 30 * 4 * 2)
    rows = blocks.collect()
    assert {(r.z, r.y, r.rows) for r in rows} == {(z, y, min(16, 40 - y)) for z in range(5) for y in (0, 16, 32)}
    for r in rows:
        assert np.array_equal(np.frombuffer(r.pixels, r.kind).reshape(r.rows, r.width), volume[r.z, r.y : r.y + r.rows])
    some = blocks.where("z >= 3 and z < 4")
    assert "z >= 3" not in some._jdf.queryExecution().executedPlan().toString() and {r.z for r in some.collect()} == {3}
    assert blocks.where("z in (1, 9)").select("z").distinct().collect() == [(1,)]
    assert blocks.where("z = 99").count() == 0
    got = K.voxels_of(blocks.where("z = 2")).collect()
    assert len(got) == 1200 and all(volume[2, r.y, r.x] == r.label for r in got)
    with pytest.raises(Exception, match="nothing"):
        K.open_volumes(spark, f"{tmp_path}/nothing.tif").count()


def test_planes_by_name(spark, tmp_path):
    for z in (2, 10):
        (tmp_path / f"D_z{z}.tif").write_bytes(tiff_bytes(np.full((1, 3, 2), z, np.float32), ">"))
    blocks = K.open_volumes(spark, f"{tmp_path}/D_z*.tif", zInName="true")
    assert {(r.z, np.frombuffer(r.pixels, r.kind)[0]) for r in blocks.collect()} == {(2, 2.0), (10, 10.0)}
    assert blocks.where("z = 10").count() == 1


def test_pages_of_many_files(spark, tmp_path):
    volume = np.zeros((3, 8, 4), np.uint16)
    (tmp_path / "good.tif").write_bytes(tiff_bytes(volume))
    (tmp_path / "bad.tif").write_bytes(b"II no")
    files = spark.createDataFrame([(f"file:{tmp_path}/good.tif", 7), (f"{tmp_path}/bad.tif", 8)], "path string, k int")
    rows = K.page_table(files, errors=True).collect()
    assert {(r.k, r.z, r.height, r.error is None) for r in rows} == {(7, 0, 8, True), (7, 1, 8, True), (7, 2, 8, True), (8, None, None, False)}
    with pytest.raises(Exception, match="bad.tif"):
        K.page_table(files).count()
