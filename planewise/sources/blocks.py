"""Volumes read block by block: a data source for one set of files, and tables of pages for scans of many."""

from __future__ import annotations

import glob
import os
import re
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from planewise.sources.tiff import Fetch, Page, pages, rows_of

#: Pixels of a block in bytes, before packing; bytes that a directory is read by; files that a task holds open.
BLOCK_BYTES, WINDOW, OPEN = 8 << 20, 1 << 16, 16

#: A page as columns of a table.
PAGE = "height int, width int, kind string, packing int, predictor int, tiled boolean, across int, down int, offsets array<long>, sizes array<long>"
_PAGE = pa.schema([("height", pa.int32()), ("width", pa.int32()), ("kind", pa.string()), ("packing", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("across", pa.int32()), ("down", pa.int32()), ("offsets", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, local or by the address of a store, and the name in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def opened(path: str) -> pa.NativeFile:
    """A file that can be read from any place."""
    store, name = place(path)
    return store.open_input_file(name)


class Files:
    """Open files by path, the last used ones; reads ranges of them."""

    def __init__(self) -> None:
        self.held: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def fetch(self, path: str) -> Fetch:
        if path in self.held:
            self.held.move_to_end(path)
        else:
            self.held[path] = opened(path)
            if len(self.held) > OPEN:
                self.held.popitem(last=False)[1].close()
        file = self.held[path]

        def read(at: int, n: int) -> bytes:
            file.seek(at)
            return file.read(n)

        return read

    def close(self) -> None:
        for file in self.held.values():
            file.close()
        self.held.clear()


def windowed(fetch: Fetch, size: int = WINDOW) -> Fetch:
    """The same bytes, by reads of ``size``: directories are many small values side by side."""
    held, begin = b"", 0

    def read(at: int, n: int) -> bytes:
        nonlocal held, begin
        if n > size:
            return fetch(at, n)
        if not begin <= at <= at + n <= begin + len(held):
            held, begin = fetch(at, size), at
        return held[at - begin :][:n]

    return read


def trimmed(page: Page, y: int, rows: int) -> tuple[Page, int]:
    """A page with no more strips or tiles than some of its rows need, and where these rows begin in it."""
    begin, end = page.bands(y, rows)
    per_row = -(-page.width // page.across)
    part = slice(begin * per_row, end * per_row)
    height = min(page.height, end * page.down) - begin * page.down
    return replace(page, height=height, offsets=page.offsets[part], sizes=page.sizes[part]), y - begin * page.down


def block_rows(page: Page, target: int = BLOCK_BYTES) -> int:
    """Rows of a block: whole strips or rows of tiles of about ``target`` bytes of pixels, one at least."""
    wide = page.width * int(page.kind[2:])
    return max(1, target // max(1, wide * page.down)) * page.down


def page_table(files: DataFrame, errors: bool = False) -> DataFrame:
    """A row for each page of each file ``path``, with all columns of ``files``, its number ``z`` and ``PAGE``.

    Only directories are read, where the tasks are.  A file that cannot be read stops the job, or, with
    ``errors``, has one row without a page that says why in ``error``.
    """
    names = files.columns

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Files()
        for part in parts:
            for i, path in enumerate(part.column(names.index("path")).to_pylist()):
                found, error = [], None
                try:
                    found = [asdict(p) for p in pages(windowed(held.fetch(path)))]
                except Exception as e:
                    if not errors:
                        raise ValueError(f"{path}: {e}") from e
                    found, error = [dict.fromkeys(_PAGE.names)], f"{type(e).__name__}: {e}"
                own = part.take(pa.array([i] * len(found), pa.int64()))
                z = pa.array(range(len(found)) if error is None else [None], pa.int32())
                columns = [pa.array([p[f.name] for p in found], f.type) for f in _PAGE]
                yield pa.RecordBatch.from_arrays([*own.columns, z, *columns, pa.array([error] * len(found), pa.string())], [*names, "z", *_PAGE.names, "error"])
        held.close()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    table = files.mapInArrow(read, f"{kinds}, z int, {PAGE}, error string")
    return table if errors else table.drop("error")


def page_of(row: dict) -> Page:
    """The page that a row of ``page_table`` describes."""
    return Page(**{k: tuple(row[k]) if k in ("offsets", "sizes") else row[k] for k in _PAGE.names})


@dataclass
class Block(D.InputPartition):
    """Some rows of a plane, and where they are."""

    path: str
    z: int
    y: int
    rows: int
    page: Page


def _passes(f: D.Filter) -> Callable[[object], bool] | None:
    """What a filter asks of its column's value, if it is one of those that planes are picked by."""
    tests: dict[type, Callable[[object], bool]] = {
        D.EqualTo: lambda v: v == f.value, D.EqualNullSafe: lambda v: v == f.value, D.In: lambda v: v in f.value,
        D.GreaterThan: lambda v: v > f.value, D.GreaterThanOrEqual: lambda v: v >= f.value, D.LessThan: lambda v: v < f.value, D.LessThanOrEqual: lambda v: v <= f.value,
        D.IsNotNull: lambda v: True, D.IsNull: lambda v: False,
    }
    return tests.get(type(f))


class VolumeReader(D.DataSourceReader):
    """Plans a partition for each block, of the files and planes that the filters leave."""

    def __init__(self, options: dict) -> None:
        given = {k.lower(): v for k, v in options.items()}
        self.path, self.pattern = given["path"], given.get("pathglobfilter")
        self.target, self.by_name = int(given.get("blockbytes", BLOCK_BYTES)), str(given.get("zinname", "false")).lower() == "true"
        self.asked: dict[str, list] = {"path": [], "z": []}

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in self.asked and _passes(f) is not None:
                self.asked[column].append(f)
            else:
                yield f

    def _wanted(self, column: str, value: object) -> bool:
        return all(_passes(f)(value) for f in self.asked[column])

    def partitions(self) -> Sequence[Block]:
        files, out = Files(), []
        found = listed(self.path, self.pattern)
        if not found:
            raise FileNotFoundError(self.path)
        for path in found:
            if self._wanted("path", path):
                number = int((re.search(r"z(\d+)", os.path.basename(path)) or [0, 0])[1])
                if self.by_name and not self._wanted("z", number):
                    continue
                for k, page in enumerate(pages(windowed(files.fetch(path)))):
                    z = number if self.by_name else k
                    if self._wanted("z", z):
                        rows = block_rows(page, self.target)
                        out += [Block(path, z, y, min(rows, page.height - y), trimmed(page, y, rows)[0]) for y in range(0, page.height, rows)]
        files.close()
        return out

    def read(self, block: Block | None) -> Iterator[pa.RecordBatch]:
        if block is None:  # no plane is left
            return
        files = Files()
        pixels = rows_of(files.fetch(block.path), block.page)
        files.close()
        kind = pixels.dtype.newbyteorder("<")
        values = [block.path, block.z, block.y, block.rows, block.page.width, kind.str, pixels.astype(kind, copy=False).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _BLOCK.types, strict=True)], schema=_BLOCK)


_BLOCK = pa.schema([("path", pa.string()), ("z", pa.int32()), ("y", pa.int32()), ("rows", pa.int32()), ("width", pa.int32()), ("kind", pa.string()), ("pixels", pa.binary())])


def listed(path: str, pattern: str | None = None) -> list[str]:
    """The files of a path, with wildcards where it is local, or of all folders below it, in order."""
    local = "://" not in path
    path = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
    if local or path.startswith("/"):
        if os.path.isdir(path):
            return sorted(glob.glob(f"{glob.escape(path)}/**/{pattern or '*'}", recursive=True))
        return sorted(glob.glob(path))
    store, name = place(path)
    head = path[: len(path) - len(name)] if path.endswith(name) else ""
    info = store.get_file_info(name)
    if info.type == fs.FileType.Directory:
        every = (f.path for f in store.get_file_info(fs.FileSelector(name, recursive=True)) if f.type == fs.FileType.File)
        test = re.compile(glob.translate(pattern or "*"))
        return sorted(head + f for f in every if test.fullmatch(os.path.basename(f)))
    return [path] if info.type == fs.FileType.File else []


class Volumes(D.DataSource):
    """``spark.read.format("volumes")``: a row for each block of rows of each plane, its pixels as little-endian bytes.

    Options: ``pathGlobFilter`` for the names of files in a folder, ``blockBytes`` for the pixels of a block, ``zInName``
    where a file is one plane, numbered by the ``z`` in its name.  Filters on ``z`` and ``path`` pick what is read.
    """

    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> str:
        return "path string, z int, y int, rows int, width int, kind string, pixels binary"

    def reader(self, schema: object) -> VolumeReader:
        return VolumeReader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> D.DataSourceArrowWriter:
        from planewise.sources.volumes import VolumeSink  # which reads scans by this module

        return VolumeSink(self.options["path"], overwrite)


def open_volumes(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The blocks of the volumes at ``path``; registers the source, and lets filters reach it, in this session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Volumes)
    return spark.read.format("volumes").options(**options).load(path)


def voxels_of(blocks: DataFrame, value: str = "label") -> DataFrame:
    """``path``, ``z``, ``y``, ``x`` and ``value`` of every pixel of some blocks, a few rows of a plane at a time."""
    import numpy as np

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.select(_BLOCK.names).to_pylist():
                pixels = np.frombuffer(r["pixels"], r["kind"]).reshape(r["rows"], r["width"])
                step = max(1, (1 << 18) // max(1, r["width"]))
                for at in range(0, r["rows"], step):
                    few = pixels[at : at + step]
                    y, x = np.indices(few.shape, dtype=np.int32)
                    n = few.size
                    columns = [pa.array([r["path"]] * n), pa.array(np.full(n, r["z"], np.int32)), pa.array(y.ravel() + np.int32(r["y"] + at)), pa.array(x.ravel()), pa.array(few.ravel().astype(np.float64))]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "z", "y", "x", value])

    return blocks.mapInArrow(spread, f"path string, z int, y int, x int, {value} double")
