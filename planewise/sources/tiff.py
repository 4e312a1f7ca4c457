"""Multi-page TIFF volumes as voxels, and tables as CSV."""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewise.sources.catalog import plane_number

# Fixed values of the TIFF format: tags, and sizes and struct codes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}


def _unpack_bits(data: bytes) -> bytes:
    """Runs of literal bytes and of repeated ones."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def _unpack_words(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, of strings that the text so far has made: LZW."""
    out = bytearray()
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    held, bits, width, last = 0, 0, 9, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code > len(table) or code == len(table) and not last:
            raise ValueError("broken LZW data")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        # codes grow one entry early
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def _unpack_zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


#: Decoders by the format's compression number.
DECODERS = {1: bytes, 5: _unpack_words, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpack_bits, 34925: lzma.decompress, 50000: _unpack_zstd}


#: Bytes from a place in a file, by offset and length.
Fetch = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Page:
    """How one plane is held in a file: strips of ``down`` rows, or tiles of ``down`` rows and ``across`` columns."""

    height: int
    width: int
    kind: str
    packing: int
    predictor: int
    tiled: bool
    across: int
    down: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]

    def bands(self, y: int, rows: int) -> tuple[int, int]:
        """The first strip, or row of tiles, of some rows of the plane, and the one after the last."""
        return y // self.down, -(-min(self.height, y + rows) // self.down)


def _directories(fetch: Fetch, order: str) -> Iterator[dict[int, tuple]]:
    """The tags of every page, of a file with offsets of 32 or 64 bits."""

    def take(kinds: str, at: int) -> tuple:
        return struct.unpack(order + kinds, fetch(at, struct.calcsize(order + kinds)))

    (version,) = take("H", 2)
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    count, wide, entry, inline = ("H", "I", 12, 4) if version == 42 else ("Q", "Q", 20, 8)
    (at,) = take(wide, 4 if version == 42 else 8)
    while at:
        (n,) = take(count, at)
        first = at + struct.calcsize(order + count)
        tags = {}
        for k in range(n):
            tag, kind, size = take("HH" + wide, first + entry * k)
            if kind in TYPES:
                where = first + entry * k + 4 + struct.calcsize(order + wide)
                if struct.calcsize(TYPES[kind]) * size > inline:
                    (where,) = take(wide, where)
                tags[tag] = take(f"{size}{TYPES[kind]}", where)
        yield tags
        (at,) = take(wide, first + entry * n)


def pages(fetch: Fetch) -> Iterator[Page]:
    """The pages of a single-channel TIFF, from its directories alone: strips or tiles, plain or packed, in either byte order."""
    begin = bytes(fetch(0, 8))
    order = {b"II": "<", b"MM": ">"}.get(begin[:2])
    if order is None or len(begin) < 8:
        raise ValueError("not a TIFF file")
    for tags in _directories(fetch, order):
        packing, predictor = tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
        tiled = TILE_OFFSETS in tags
        if packing not in DECODERS or predictor not in (1, 2) or tags.get(SAMPLES, (1,))[0] != 1 or not (tiled or OFFSETS in tags) or tags[BITS][0] % 8:
            raise ValueError("only single-channel pages of whole bytes, in a known compression, are supported")
        height, width = tags[HEIGHT][0], tags[WIDTH][0]
        kind = f"{order}{KINDS[tags.get(FORMAT, (1,))[0]]}{tags[BITS][0] // 8}"
        across, down = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(height, tags.get(ROWS, (height,))[0]))
        offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[OFFSETS], tags[COUNTS])
        if len(offsets) != len(sizes):
            raise ValueError("as many offsets as sizes are needed")
        page = Page(height, width, kind, packing, predictor, tiled, across, down, offsets, sizes)
        yield _finer(page) if packing == 1 and not tiled else page


def _finer(page: Page, size: int = 1 << 20) -> Page:
    """The same page of plain strips, cut to about ``size`` bytes, so that a strip of any length is read in parts."""
    line = page.width * int(page.kind[2:])
    rows = max(1, size // max(1, line))
    if len(page.offsets) > 1:
        rows = max(r for r in range(1, min(rows, page.down) + 1) if page.down % r == 0)
    if rows >= page.down:
        return page
    cuts = [(at + r * line, min(rows * line, n - r * line)) for at, n in zip(page.offsets, page.sizes, strict=True) for r in range(0, n // line, rows)]
    return replace(page, down=rows, offsets=tuple(at for at, _ in cuts), sizes=tuple(n for _, n in cuts))


def _segments(fetch: Fetch, offsets: Sequence[int], sizes: Sequence[int]) -> Iterator[memoryview]:
    """The data of strips or tiles; those that follow each other in the file are fetched at once."""
    at = 0
    while at < len(offsets):
        end, length = at + 1, sizes[at]
        while end < len(offsets) and offsets[end] == offsets[at] + length:
            length += sizes[end]
            end += 1
        data = memoryview(fetch(offsets[at], length))
        if len(data) != length:
            raise ValueError("the file ends early")
        for k in range(at, end):
            yield data[offsets[k] - offsets[at] :][: sizes[k]]
        at = end


def rows_of(fetch: Fetch, page: Page, y: int = 0, rows: int | None = None) -> np.ndarray:
    """Some rows of a plane; only the strips or tiles that they touch are read."""
    rows = min(page.height - y, page.height if rows is None else rows)
    begin, end = page.bands(y, rows)
    kind, per_row = np.dtype(page.kind), -(-page.width // page.across)
    decode, plain = DECODERS[page.packing], page.packing == 1
    part = slice(begin * per_row, end * per_row)
    out = np.empty(((end - begin) * page.down, per_row * page.across), kind)
    for k, data in enumerate(_segments(fetch, page.offsets[part], page.sizes[part])):
        row, column = divmod(k, per_row)
        high = page.down if page.tiled else min(page.down, page.height - (begin + row) * page.down)
        piece = np.frombuffer(data if plain else decode(bytes(data)), kind, high * page.across).reshape(high, page.across)
        if page.predictor == 2:  # each value is held as its step from the one before it
            piece = np.cumsum(piece, axis=1, dtype=kind.newbyteorder("="))
        out[row * page.down : row * page.down + high, column * page.across : (column + 1) * page.across] = piece
    skipped = y - begin * page.down
    return out[skipped : skipped + rows, : page.width]


def planes(data: bytes) -> Iterator[np.ndarray]:
    """The pages of a whole file."""

    def fetch(at: int, n: int) -> bytes:
        return data[at : at + n]

    for page in pages(fetch):
        yield rows_of(fetch, page)


def load_volumes(spark: SparkSession, path: str, value: str, single_plane: bool = False) -> DataFrame:
    """``path``, ``z``, ``y``, ``x`` and ``value`` of every pixel of all matching files.

    A file is a volume of one plane per page; with ``single_plane`` each file is one plane, numbered by the ``z``
    in its name.  Files are decoded where they are read, page by page.  No matching file is an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", plane_number(F.col("path")).alias("z0"), "content")
    if files.select("path").isEmpty():
        raise FileNotFoundError(path)

    def pixels(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, z0, content in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for z, plane in enumerate(planes(content)):
                    y, x = np.indices(plane.shape, dtype=np.int32)
                    n = plane.size
                    columns = [pa.array([name] * n), pa.array(np.full(n, z0 if single_plane else z, np.int32)), pa.array(y.ravel()), pa.array(x.ravel()), pa.array(plane.ravel().astype(np.float64))]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "z", "y", "x", value])

    return files.mapInArrow(pixels, f"path string, z int, y int, x int, {value} double")


def paired_voxels(labels: DataFrame, intensity: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Labels with the brightness beneath them; volumes of different shape are an error."""
    shape = [F.count("*"), *(f(c) for c in ("z", "y", "x") for f in (F.min, F.max))]
    own, theirs = ({tuple(r) for r in v.groupBy(*keys).agg(*shape).collect()} for v in (labels, intensity))  # a row for each volume
    if own != theirs:
        raise ValueError("labels and intensity differ in shape")
    return labels.join(intensity, [*keys, "z", "y", "x"]).withColumn("label", F.col("label").cast("long"))


def load_fov(spark: SparkSession, masks_path: str, intensity_glob: str | None = None, name: str | None = None) -> DataFrame:
    """One field's voxels, ``fov`` being the name given or that of the folder; with the brightness, where planes are given."""
    labels = load_volumes(spark, masks_path, "label").drop("path").withColumn("label", F.col("label").cast("long"))
    if intensity_glob is not None:
        labels = paired_voxels(labels, load_volumes(spark, intensity_glob, "brightness", single_plane=True).drop("path"))
    return labels.withColumn("fov", F.lit(name or masks_path.rstrip("/").split("/")[-2]))


def write_tables(within: DataFrame, across: DataFrame, stem: str, mode: str = "error") -> None:
    """Two tables as CSV with header, ``<stem>_within`` and ``<stem>_across``; what is there already is an error unless asked for."""
    for name, table in (("within", within), ("across", across)):
        table.write.mode(mode).option("header", True).csv(f"{stem}_{name}")


def print_tables(within: DataFrame, across: DataFrame, rows: int = 100) -> None:
    """The same two tables on the screen, the first rows of each."""
    for table in (within, across):
        table.show(rows, truncate=False)
