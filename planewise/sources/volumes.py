"""Label volumes written plane by plane: a sink whose tasks write files and whose commit publishes all of them, or none."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from planewise.functions.columns import IMAGE, KEYS
from planewise.sources.blocks import Files, Volumes, place
from planewise.sources.regions import BlockScan, block_pixels

#: What the sink takes: rows of a plane, in order, with all of a plane's rows in one task.
BLOCKS = "name string, z int, y int, rows int, width int, height int, kind string, pixels binary"


class PageWriter:
    """A file of one page, written strip by strip: packed strips, then the directory that lists them."""

    def __init__(self, file: pa.NativeFile, height: int, width: int, kind: np.dtype, rows: int) -> None:
        self.file, self.height, self.width, self.kind, self.rows = file, height, width, kind.newbyteorder("<"), rows
        self.places: list[tuple[int, int]] = []
        self.at = self.done = 0
        self._put(b"II" + struct.pack("<HHHQ", 43, 8, 0, 0))

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.at += len(data)

    def add(self, pixels: np.ndarray) -> None:
        """Some rows; all strips but the last are of the same height."""
        for y in range(0, len(pixels), self.rows):
            data = zlib.compress(pixels[y : y + self.rows].astype(self.kind, copy=False).tobytes(), 1)
            self.places.append((self.at, len(data)))
            self._put(data)
        self.done += len(pixels)

    def close(self) -> bytes:
        """Write the directory; returns the header that says where it is, which goes to the beginning."""
        if self.done != self.height:
            raise ValueError(f"{self.done} rows of a plane of {self.height}")
        lists = []
        for values in zip(*self.places, strict=True):
            lists.append(self.at)
            self._put(struct.pack(f"<{len(values)}Q", *values))
        n = len(self.places)
        ends = lists if n > 1 else self.places[0]
        form = {"u": 1, "i": 2, "f": 3}[self.kind.kind]
        tags = [(256, 4, 1, self.width), (257, 4, 1, self.height), (258, 3, 1, self.kind.itemsize * 8), (259, 3, 1, 8), (273, 16, n, ends[0]), (277, 3, 1, 1), (278, 4, 1, self.rows), (279, 16, n, ends[1]), (339, 3, 1, form)]
        header = b"II" + struct.pack("<HHHQ", 43, 8, 0, self.at)
        self._put(struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", *t) for t in tags) + struct.pack("<Q", 0))
        return header


@dataclass
class Written(D.WriterCommitMessage):
    """The planes that a task has written, below the folder that is not public yet."""

    files: list[str]


class VolumeSink(D.DataSourceArrowWriter):
    """Writes ``<path>/<name>/z<number>.tif``; nothing is at ``path`` until all tasks are done."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.pending = f"{self.path}.pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = place(self.pending)
        own = f"{root}/attempt-{TaskContext.get().taskAttemptId()}"
        files: list[str] = []
        plane: tuple | None = None
        page: PageWriter | None = None
        held: pa.BufferOutputStream | None = None

        def finish() -> None:
            if page is not None:
                header = page.close()
                data = held.getvalue()
                name = f"{plane[0]}/z{plane[1]:05}.tif"
                store.create_dir(f"{own}/{plane[0]}", recursive=True)
                with store.open_output_stream(f"{own}/{name}", compression=None) as out:
                    out.write(header)
                    out.write(data.slice(len(header)))
                files.append(f"{own.removeprefix(root + '/')}/{name}")

        for batch in iterator:
            for r in batch.to_pylist():
                kind = np.dtype(r["kind"])
                if plane != (r["name"], r["z"]):
                    finish()
                    plane, held = (r["name"], r["z"]), pa.BufferOutputStream()
                    page = PageWriter(held, r["height"], r["width"], kind, r["rows"])
                if r["y"] != page.done:
                    raise ValueError(f"{plane}: rows from {r['y']} come after {page.done}")
                page.add(np.frombuffer(r["pixels"], kind).reshape(r["rows"], r["width"]))
        finish()
        return Written(files)

    def commit(self, messages: list) -> None:
        store, root = place(self.pending)
        target = place(self.path)[1]
        store.create_dir(f"{root}/ready", recursive=True)
        for m in messages:
            for f in m.files if m else []:
                name = f.split("/", 1)[1]
                store.create_dir(f"{root}/ready/{name.rsplit('/', 1)[0]}", recursive=True)
                store.move(f"{root}/{f}", f"{root}/ready/{name}")
        if store.get_file_info(target).type != fs.FileType.NotFound:
            if not self.overwrite:
                store.delete_dir(root)
                raise FileExistsError(self.path)
            store.move(target, f"{root}/old")
        store.move(f"{root}/ready", target)
        store.delete_dir(root)

    def abort(self, messages: list) -> None:
        store, root = place(self.pending)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


def _save(blocks: DataFrame, path: str, overwrite: bool) -> None:
    blocks.sparkSession.dataSource.register(Volumes)
    blocks.write.format("volumes").mode("overwrite" if overwrite else "append").save(path)


def write_voxels(voxels: DataFrame, path: str, value: str = "label", kind: str = "uint32", keys: tuple[str, ...] = KEYS, shape: tuple[int, int] | None = None, overwrite: bool = False) -> None:
    """Volumes of voxels as rows, one folder ``<key>/<key>/...`` for each volume; what is no voxel is 0.

    Planes are as high and wide as ``shape`` says, else as the volume's voxels reach; a task holds one plane at a time.
    A plane without voxels has no file.
    """
    names = voxels.select(F.concat_ws("/", *keys).alias("name"), "z", "y", "x", F.col(value).alias("value"))
    if shape is None:
        ends = names.groupBy("name").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"))
        names = names.join(ends, "name")
    else:
        names = names.withColumns({"height": F.lit(shape[0]), "width": F.lit(shape[1])})

    def plane(own: pa.Table) -> pa.Table:
        height, width = own.column("height")[0].as_py(), own.column("width")[0].as_py()
        pixels = np.zeros((height, width), kind)
        pixels[own.column("y").to_numpy(), own.column("x").to_numpy()] = own.column("value").to_numpy()
        rows = max(1, min(height, (1 << 20) // max(1, width * pixels.itemsize)))
        out = [(own.column("name")[0].as_py(), own.column("z")[0].as_py(), y, min(rows, height - y), width, height, pixels.dtype.str, pixels[y : y + rows].tobytes()) for y in range(0, height, rows)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)

    _save(names.groupBy("name", "z").applyInArrow(plane, BLOCKS), path, overwrite)


_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()]


def write_kept(scan: BlockScan, path: str, dropped: bool = False, overwrite: bool = False) -> None:
    """The volumes of a scan after the filter, labels that it drops being background, or, if asked for, those labels alone.

    A task reads the blocks of a plane, in order, and writes them: what is shuffled before are places in files.
    """
    gone = scan.dropped.join(scan.spans.select(*KEYS, "label", F.col("z_start").alias("z")), [*KEYS, "label"])
    gone = gone.groupBy(*KEYS, "z").agg(F.collect_list("label").alias("gone"))
    blocks = scan.blocks.withColumn("m", F.explode("masks")).select(*IMAGE, "z", "y", "rows", "height", F.col("m.method").alias("method"), F.col("m.page").alias("page"))
    blocks = blocks.join(gone, [*KEYS, "z"], "left").withColumn("name", F.concat_ws("/", *KEYS)).select("name", "z", "y", "rows", "height", "page", "gone")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        for part in parts:
            for r in part.to_pylist():
                pixels = block_pixels(files, r["page"], r["y"], r["rows"])
                hit = np.isin(pixels, np.array(r["gone"] or [], np.int64))
                pixels = np.where(hit == dropped, pixels, 0).astype(pixels.dtype.newbyteorder("<"))
                row = (r["name"], r["z"], r["y"], r["rows"], pixels.shape[1], r["height"], pixels.dtype.str, pixels.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], _NAMES)
        files.close()

    ordered = blocks.repartition("name", "z").sortWithinPartitions("name", "z", "y")
    _save(ordered.mapInArrow(read, BLOCKS), path, overwrite)
