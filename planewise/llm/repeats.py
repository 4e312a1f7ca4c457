"""What the two searches for repeated passages share: sampling, counting and whole texts by key.

A *window* is a string of a fixed number of units (bytes or words).  Every window picks one q-gram in it, its
*anchor*, by the content alone; neighbouring windows of a text with the same anchor make a *block*.  Two equal
windows have equal anchors, so only blocks whose anchor occurs elsewhere can hold a repeated window, and blocks
that are equal as a whole are settled without looking at their windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewise.llm import grams
from planewise.llm.common import split_join, stored

#: Bytes of text that a worker hashes at a time.
CHUNK = 1 << 18

Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``body`` (null: empty), and ``key`` with ``tag``, which only rows with one id and one text share.

    The key is the id, or a hash of the text where there is none; the tag is another 64-bit hash of the text.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), body.alias("body"))
    return rows.select("id", F.coalesce("id", F.xxhash64(F.lit(7), "body")).alias("key"), F.xxhash64("body").alias("tag"), "body")


def sliced(parts: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what a worker derives from one at a time stays small."""
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)
        pa.default_memory_pool().release_unused()


def packed(rows: DataFrame) -> DataFrame:
    """``id``, ``key``, ``tag`` and the compressed text ``z``: what is shuffled to meet the spans found in it."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for part in sliced(parts):
            z = [squeeze(t) for t in part.column(3).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(z, pa.binary())], ["id", "key", "tag", "z"])

    return rows.mapInArrow(batches, "id long, key long, tag long, z binary")


@cache
def _opener() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def opened(z: bytes) -> bytes:
    return _opener().decompress(z)


def blocks(rows: DataFrame, find: Callable[[pa.Array], Iterator[Found]], bits: int) -> DataFrame:
    """Blocks of all texts: anchor bucket ``h`` of ``bits`` bits, content hash ``b``, ``key``, ``tag``, and ``place``.

    ``place`` packs the unit at which the block's first window begins and how many windows it has.  ``find``
    gives, for an Arrow array of texts, arrays of text number, anchor, content, start and count.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            for which, anchor, content, start, count in find(part.column(3)):
                # an anchor is the least of many ids, so its leading bits are mostly zero until it is mixed again
                anchor = grams.mix(anchor, anchor)
                columns = [
                    pa.array((anchor >> np.uint64(64 - bits)).astype(np.int64), pa.int64()),
                    pa.array(content.view(np.int64)),
                    *(part.column(c).take(pa.array(which)) for c in (1, 2)),
                    pa.array((start << 8) | count, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["h", "b", "key", "tag", "place"])

    return rows.mapInArrow(batches, "h long, b long, key long, tag long, place long")


def unpacked(place: str = "place") -> tuple[Column, Column]:
    """Start and count that ``place`` packs."""
    return F.expr(f"shiftright({place}, 8)").alias("start"), F.expr(f"cast({place} & 255 as int)").alias("count")


def anchor_bits(rows: DataFrame, units_per_block: float) -> int:
    """Enough bits to tell the anchors of all texts apart: 64 times as many buckets as anchors, whatever the size."""
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    return min(62, max(24, math.ceil(math.log2(total / units_per_block + 1)) + 6))


def repeated(found: DataFrame) -> DataFrame:
    """The blocks whose anchor bucket has more than one block, written once to shared storage."""
    often = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return stored(split_join(found, often, "h", "n"))


def with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``packed`` texts with all ``spans`` of each (structs of start and end), null where there are none."""
    each = spans.groupBy(F.col("key").alias("skey"), F.col("tag").alias("stag")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return texts.join(each, (texts["key"] == each["skey"]) & (texts["tag"] == each["stag"]), "left").select("id", "z", "spans")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the intervals: sorted, disjoint and not touching."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    at = np.flatnonzero(new)
    return starts[at], ends[np.concatenate([at[1:] - 1, [len(starts) - 1]])]


def span_arrays(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Start and end arrays of each entry of a list-of-structs column; null is none."""
    column = column.fill_null([]) if column.null_count else column
    offsets = column.offsets.to_numpy()
    values = column.values
    starts, ends = (values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield starts[a:b], ends[a:b]
