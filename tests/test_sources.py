from __future__ import annotations

import lzma
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from planewise.operators.areas import plane_areas
from planewise.sources import catalog as G
from planewise.sources import tiff
from planewise.sources.scans import scan_segmentations
from planewise.streaming.areas import streaming_areas


def tiff_bytes(volume: np.ndarray, order: str = "<") -> bytes:
    """An uncompressed file of one strip for each page."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))
    for k, page in enumerate(volume):
        data = page.astype(page.dtype.newbyteorder(order)).tobytes()
        tags = [(256, 4, page.shape[1]), (257, 4, page.shape[0]), (258, 3, page.dtype.itemsize * 8), (259, 3, 1), (273, 4, 0), (277, 3, 1), (279, 4, len(data)), (339, 3, 3 if page.dtype.kind == "f" else 1)]
        size = 2 + 12 * len(tags) + 4
        offset = len(out) + size
        out += struct.pack(order + "H", len(tags))
        for tag, kind, value in tags:
            value = offset if tag == 273 else value
            out += struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
        out += struct.pack(order + "I", 0 if k == len(volume) - 1 else offset + len(data)) + data
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
def test_volumes_round_trip(spark, tmp_path, order):
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 4, (3, 5, 6)).astype(np.uint16)
    for method in ("a", "b"):
        (tmp_path / method / "r1" / "f1").mkdir(parents=True)
        (tmp_path / method / "r1" / "f1" / "masks.tif").write_bytes(tiff_bytes(labels, order))
    got = tiff.load_volumes(spark, f"{tmp_path}/a/*/*/masks.tif", "label").collect()
    assert all(labels[r.z, r.y, r.x] == r.label for r in got) and len(got) == labels.size
    found = G.catalog(spark, {"a": f"{tmp_path}/a", "b": f"{tmp_path}/b"})
    assert [tuple(r)[:4] for r in G.find_region_fovs(found, 2).collect()] == [("r1", "f1", "a", 0), ("r1", "f1", "b", 1)]
    assert [r.region for r in G.available_regions(found, 2).collect()] == ["r1"]
    assert G.find_region_fovs(found, 3).count() == 0


def test_planes_stack_by_number_and_shapes_must_agree(spark, tmp_path):
    for z in (2, 10):
        (tmp_path / f"DAPI_z{z}.tif").write_bytes(tiff_bytes(np.full((1, 2, 2), z, np.float32)))
    light = tiff.load_volumes(spark, f"{tmp_path}/DAPI_z*.tif", "brightness", single_plane=True).drop("path")
    assert {(r.z, r.brightness) for r in light.collect()} == {(2, 2.0), (10, 10.0)}
    assert tiff.paired_voxels(light.withColumnRenamed("brightness", "label"), light).count() == 8
    with pytest.raises(ValueError):
        tiff.paired_voxels(light.withColumnRenamed("brightness", "label"), light.where("z = 2"))
    with pytest.raises(Exception, match="nothing"):
        tiff.load_volumes(spark, f"{tmp_path}/nothing*.tif", "label")


def packed_bits(data: bytes) -> bytes:
    out = bytearray()
    for at in range(0, len(data), 100):
        part = data[at : at + 100]
        out += bytes((257 - len(part), part[0])) if len(set(part)) == 1 and len(part) > 1 else bytes((len(part) - 1,)) + part
    return bytes(out)


def packed_words(data: bytes) -> bytes:
    table, bits, width, held = {bytes((i,)): i for i in range(256)}, [], 9, b""

    def put(code):
        bits.extend(code >> k & 1 for k in range(width - 1, -1, -1))

    put(256)
    size = 258
    for k in range(len(data)):
        longer = held + data[k : k + 1]
        if longer in table:
            held = longer
            continue
        put(table[held])
        table[longer] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            put(256)
            table, size, width = {bytes((i,)): i for i in range(256)}, 258, 9
        held = data[k : k + 1]
    if held:
        put(table[held])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    bits += [0] * (-len(bits) % 8)
    return bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8))


def zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


PACKERS = {1: bytes, 5: packed_words, 8: zlib.compress, 32773: packed_bits, 34925: lzma.compress, 50000: zstd}


def packed_tiff(page: np.ndarray, compression: int, tile: tuple[int, int] | None, big: bool, predictor: int = 1) -> bytes:
    """One page in strips of 7 rows, or in tiles, with 32- or 64-bit offsets."""
    height, width = page.shape
    down, across = tile or (7, width)
    wide, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    out = bytearray(b"II" + (struct.pack("<HHHQ", 43, 8, 0, 0) if big else struct.pack("<HI", 42, 0)))
    places = []
    for y in range(0, height, down):
        for x in range(0, width, across):
            part = page[y : y + down, x : x + across]
            if tile:
                part = np.pad(part, ((0, down - part.shape[0]), (0, across - part.shape[1])))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=part[:, :1] * 0)
            data = PACKERS[compression](part.astype(page.dtype).tobytes())
            places.append((len(out), len(data)))
            out += data
    lists = []
    for values in zip(*places, strict=True):
        lists.append(len(out))
        out += struct.pack(f"<{len(values)}{wide}", *values)
    n = len(places)
    kind = 16 if big else 4
    tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, page.dtype.itemsize * 8), (259, 3, 1, compression), (317, 3, 1, predictor)]
    ends = [places[0][0], places[0][1]] if n == 1 else lists
    tags += [(322, 4, 1, across), (323, 4, 1, down), (324, kind, n, ends[0]), (325, kind, n, ends[1])] if tile else [(273, kind, n, ends[0]), (278, 4, 1, down), (279, kind, n, ends[1])]
    struct.pack_into("<" + wide, out, 8 if big else 4, len(out))
    out += struct.pack("<" + count, len(tags))
    for tag, k, size, value in sorted(tags):
        out += struct.pack("<HH" + wide, tag, k, size) + struct.pack("<" + wide, value)
    assert entry
    return bytes(out) + struct.pack("<" + wide, 0)


@pytest.mark.parametrize("compression", sorted(PACKERS))
@pytest.mark.parametrize(("tile", "big", "predictor"), [(None, False, 1), ((16, 16), False, 2), ((16, 32), True, 1), (None, True, 2)])
def test_packed_pages(compression, tile, big, predictor):
    rng = np.random.default_rng(3)
    page = rng.integers(0, 900, (45, 70)).astype(np.uint16)
    page[10:30] = 7
    (got,) = tiff.planes(packed_tiff(page, compression, tile, big, predictor))
    assert np.array_equal(got, page)
    assert next(tiff.planes(packed_tiff(page[:7], compression, None, big, 1))).shape == (7, 70)


def test_scan_of_folders(spark, tmp_path):
    """Levels become columns, volumes without labels count, and a broken file does not stop the scan."""
    volume = np.zeros((4, 3, 3), np.uint16)
    volume[0, 0, 0] = volume[2, 0, :2] = 5
    volume[1, 1] = 9
    for name, data in (("m1/r/f1", tiff_bytes(volume)), ("m1/r/f2", tiff_bytes(volume * 0)), ("m2/r/f1", b"II but no image")):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "masks.tif").write_bytes(data)
    found = scan_segmentations(spark, str(tmp_path), level_names=("region", "fov"))
    rows = {(r.level_0, r.region, r.fov): (r.n_labels, r.pct_multi_layer, r.max_z_span, r.n_with_z_gaps) for r in found.summary.collect()}
    assert rows == {("m1", "r", "f1"): (2, 50.0, 3, 1), ("m1", "r", "f2"): (0, None, None, 0)}
    assert {(r.relpath, r.label, r.z_start, r.z_end, r.z_span, r.n_planes, r.n_voxels, r.spans_multiple_layers) for r in found.labels.collect()} == {
        ("m1/r/f1/masks.tif", 5, 0, 2, 3, 2, 3, True), ("m1/r/f1/masks.tif", 9, 1, 1, 1, 1, 3, False)
    }
    assert [(r.relpath, "TIFF" in r.error) for r in found.failures.collect()] == [("m2/r/f1/masks.tif", True)]
    with pytest.raises(FileNotFoundError):
        scan_segmentations(spark, str(tmp_path), pattern="nothing.tif")


def test_one_field(spark, tmp_path):
    (tmp_path / "f7").mkdir()
    (tmp_path / "f7" / "masks.tif").write_bytes(tiff_bytes(np.ones((2, 2, 2), np.uint16)))
    for z in (0, 1):
        (tmp_path / f"d_z{z}.tif").write_bytes(tiff_bytes(np.full((1, 2, 2), z, np.float32)))
    got = tiff.load_fov(spark, f"{tmp_path}/f7/masks.tif", f"{tmp_path}/d_z*.tif").collect()
    assert {(r.fov, r.label, r.z, r.brightness) for r in got} == {("f7", 1, 0, 0.0), ("f7", 1, 1, 1.0)}
    assert "brightness" not in tiff.load_fov(spark, f"{tmp_path}/f7/masks.tif", name="x").columns


def test_stream_equals_batch(spark, tmp_path):
    rows = [("r", "f", "m", k % 3, k % 4) for k in range(50)]
    voxels = spark.createDataFrame(rows, "region string, fov string, method string, z int, label long")
    voxels.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(voxels.schema).parquet(f"{tmp_path}/in")
    running = streaming_areas(stream).writeStream.outputMode("complete").format("memory").queryName("areas").start()
    running.processAllAvailable()
    running.stop()
    assert sorted(map(tuple, spark.table("areas").collect())) == sorted(map(tuple, plane_areas(voxels).collect()))


def test_csv_tables(spark, tmp_path):
    one = spark.range(2)
    tiff.write_tables(one, one, f"{tmp_path}/cut")
    assert spark.read.option("header", True).csv(f"{tmp_path}/cut_within").count() == 2
    with pytest.raises(Exception, match="exists"):
        tiff.write_tables(one, one, f"{tmp_path}/cut")


def test_paths_of_planes_and_tables_on_the_screen(spark, capsys):
    path = spark.range(1).select(G.fov_glob("/images/r1", F.lit("f1"), "DAPI_decon_z*.tif")).first()[0]
    assert path == "/images/r1/f1/DAPI_decon_z*.tif"
    tiff.print_tables(spark.range(3).withColumnRenamed("id", "within"), spark.range(5).withColumnRenamed("id", "across"), 2)
    shown = capsys.readouterr().out
    assert "within" in shown and "across" in shown and "only showing top 2 rows" in shown
