"""Exact substring dedup: bytes covered by a long string that starts anywhere else too."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.llm import grams
from planewise.llm.common import split_join
from planewise.llm.repeats import CHUNK, Found, anchor_bits, blocks, keyed, merged, opened, packed, repeated, sliced, span_arrays, unpacked, with_spans

LENGTH = 200
#: The q-grams that make the initial buckets are so many bytes shorter than the strings.
WINDOWS = 136
#: Distinct blocks that a bucket may have to be refined within one task; larger ones are refined by a shuffle.
CROWDED = 4096
#: Windows that are refined at a time, and bytes of a long text that are hashed at a time.
UNIT, PIECE = 250_000, 1 << 20


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at every place as one number."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data.tobytes(), strides=(1,))


def _buckets(data: np.ndarray, length: int) -> np.ndarray:
    """Bucket ids of every ``length`` bytes (8 at least): 8-byte words first, then refined by the bucket that follows."""
    ids, q = _words(data), 8
    while q < length:
        step = min(q, length - q)
        ids = grams.mix(ids[: len(ids) - step], ids[step:])
        q += step
    return ids


def _chunks(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Texts end to end, about ``CHUNK`` bytes at a time, with offsets, the first text's number and its first byte.

    A longer text comes in pieces that overlap, so that each window is in one piece.
    """
    data, offsets = grams.text_bytes(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        low, high = int(offsets[at]), int(offsets[stop])
        if high - low <= 2 * PIECE:
            yield data[low:high], offsets[at : stop + 1] - low, at, 0
        else:
            for first in range(0, high - low, PIECE):
                piece = data[low + first : min(high, low + first + PIECE + length - 1)]
                yield piece, np.array([0, len(piece)]), at, first
        at = stop


def find_blocks(column: pa.Array, length: int, gram: int) -> Iterator[Found]:
    """Text number, anchor, content hash, first window and number of windows of all blocks."""
    for data, offsets, text, first in _chunks(column, length):
        if len(data) < length:
            continue
        ids = _buckets(data, gram)
        anchors = grams.anchored(ids, length - gram + 1)
        long = np.diff(offsets) >= length
        begin, end = offsets[:-1][long], offsets[1:][long] - length + 1
        a, b = grams.block_edges(anchors, begin, end)
        # the first and the last window together cover the block, since all its windows share the anchor
        content = grams.mix(_window(ids, a, length, gram), _window(ids, b, length, gram))
        which = np.searchsorted(offsets, a, "right") - 1
        yield which + text, ids[anchors[a]], content, a - offsets[which] + first, b - a + 1


def _window(ids: np.ndarray, at: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Bucket ids of the windows at these places, by the pointers to the buckets at later offsets."""
    if length == gram:
        return ids[at]
    q = gram
    while 2 * q < length:
        q *= 2
    return grams.mix(_window(ids, at, q, gram), _window(ids, at + length - q, q, gram))


def _pieces(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the ``wanted`` blocks (h, key, tag, start, count, alone), cut out of the whole texts."""
    lists = wanted.groupBy(F.col("key").alias("wkey"), F.col("tag").alias("wtag")).agg(F.collect_list(F.struct("h", "start", "count", "alone")).alias("all"))
    joined = texts.join(lists, (texts["key"] == lists["wkey"]) & (texts["tag"] == lists["wtag"])).select("key", "tag", "z", "all")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in sliced(parts, 200):
            out: list[list] = [[] for _ in range(7)]
            for key, tag, z, every in zip(*(c.to_pylist() for c in few.columns), strict=True):
                body = opened(z)
                for x in every:
                    row = (x["h"], key, tag, x["start"], x["count"], x["alone"], body[x["start"] : x["start"] + x["count"] + length - 1])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["h", "key", "tag", "start", "count", "alone", "piece"])

    return joined.mapInArrow(batches, "h long, key long, tag long, start long, count int, alone boolean, piece binary")


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece of every window, and its number within the piece."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def refine(ids: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows at ``at`` that share a bucket with another one, sorted by bucket, and the bucket of each.

    Every pass sorts what is left on the present bucket and on the bucket id, of ``gram`` bytes, at the next later
    offset; the new buckets are those that the pass after it refines.  A bucket with one member is final and leaves.
    """
    live, bucket = np.arange(len(at)), np.zeros(len(at), np.int64)
    for offset in [*range(0, length - gram, gram), length - gram]:
        if not len(live):
            break
        pointer = ids[at[live] + offset]
        order = np.lexsort((pointer, bucket))
        bucket, pointer = bucket[order], pointer[order]
        rank = np.concatenate([[0], np.cumsum((bucket[1:] != bucket[:-1]) | (pointer[1:] != pointer[:-1]))])
        shared = np.bincount(rank)[rank] > 1
        live, bucket = live[order[shared]], rank[shared]
    return live, bucket


def same_bytes(data: np.ndarray, at: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows at ``at``, sorted by bucket, have their bytes in common with another one of their bucket."""
    words = _words(data)
    first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    least = at[first][np.cumsum(first) - 1]
    same = np.ones(len(at), bool)
    for offset in [*range(0, length - 8, 8), length - 8]:
        same &= words[at + offset] == words[least + offset]
    if same.all():
        return same
    # ids that agree by chance: these buckets are told apart by their bytes
    for b in np.unique(bucket[~same]):
        own = np.flatnonzero(bucket == b)
        texts = [data[at[i] : at[i] + length].tobytes() for i in own]
        often = Counter(texts)
        same[own] = [often[t] > 1 for t in texts]
    return same


def _refined(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans of the windows, of blocks that stand alone, that some other place has as well; whole anchor buckets at a time."""

    def unit(table: pa.Table) -> pa.RecordBatch:
        counts = table.column("count").to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(table.column("piece").to_pylist()), np.uint8)
        row, within = _spread(counts)
        at = (np.cumsum(counts + length - 1) - (counts + length - 1))[row] + within
        live, bucket = refine(_buckets(data, gram), at, length, gram)
        flags = np.zeros(len(row), bool)
        if len(live):
            flags[live] = same_bytes(data, at[live], bucket, length)
        flags &= np.repeat(table.column("alone").to_numpy(), counts)
        # a run ends with its block
        edge = np.zeros(len(row) + 1, bool)
        edge[np.cumsum(counts)] = True
        opens = flags & ~(np.concatenate([[False], flags[:-1]]) & ~edge[:-1])
        closes = flags & ~(np.concatenate([flags[1:], [False]]) & ~edge[1:])
        a, b = np.flatnonzero(opens), np.flatnonzero(closes)
        start = table.column("start").to_numpy()[row[a]] + within[a]
        picked = pa.array(row[a])
        keys = [table.column(c).combine_chunks().take(picked) for c in ("key", "tag")]
        return pa.RecordBatch.from_arrays([*keys, pa.array(start), pa.array(start + (b - a) + length)], ["key", "tag", "start", "end"])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for part in parts:
            held.append(part)
            size += int(part.column(4).to_numpy().sum())
            if size >= UNIT:
                table = pa.Table.from_batches(held)
                h = table.column("h").to_numpy()
                whole = int(np.searchsorted(h, h[-1]))  # the last bucket may go on in the next batch
                if whole:
                    yield unit(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                size = int(table.slice(whole).column("count").to_numpy().sum())
        if size:
            yield unit(pa.Table.from_batches(held))

    # a bucket's blocks meet in one task, at most CROWDED of them; a task takes its buckets in order
    return pieces.repartition("h").sortWithinPartitions("h").mapInArrow(batches, "key long, tag long, start long, end long")


def _refined_by_shuffle(pieces: DataFrame, length: int) -> DataFrame:
    """The same for crowded buckets: one row for each window, told apart by 128 bits and counted with partial sums."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, part.num_rows, 2000):
                few = part.slice(lo, 2000)
                counts = few.column(4).to_numpy().astype(np.int64)
                data = np.frombuffer(b"".join(few.column(6).to_pylist()), np.uint8)
                row, within = _spread(counts)
                at = (np.cumsum(counts + length - 1) - (counts + length - 1))[row] + within
                ids = _buckets(data, length)[at]
                halves = _buckets(data, length - length // 3)
                other = grams.mix(halves[at + length // 3], halves[at])
                picked = pa.array(row)
                columns = [few.column(c).take(picked) for c in (1, 2, 5)]
                start = few.column(3).to_numpy()[row] + within
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids.view(np.int64)), pa.array(other.view(np.int64)), pa.array(start)], ["key", "tag", "alone", "w", "w2", "start"])

    windows = pieces.mapInArrow(batches, "key long, tag long, alone boolean, w long, w2 long, start long")
    often = windows.groupBy("w", "w2").agg(F.count("*").alias("n")).where("n > 1")
    hit = split_join(windows.where("alone"), often, ["w", "w2"], "n")
    return hit.select("key", "tag", "start", (F.col("start") + length).alias("end"))


def repeated_spans(rows: DataFrame, texts: DataFrame, length: int, gram: int, crowded: int = CROWDED) -> DataFrame:
    """``key``, ``tag``, ``start`` and ``end`` of strings, ``length`` bytes at least, whose windows all start elsewhere too."""
    found = blocks(rows, lambda column: find_blocks(column, length, gram), anchor_bits(rows, (length - gram + 2) / 2))
    again = repeated(found)
    # blocks that are equal as a whole need no refinement
    kinds = again.groupBy("h", "b").agg(F.count("*").alias("n"), F.min(F.struct("key", "tag", "place")).alias("one"))
    settled = split_join(again, kinds.where("n > 1").select("h", "b", "n"), ["h", "b"], "n")
    settled = settled.select("key", "tag", *unpacked()).select("key", "tag", "start", (F.col("start") + F.col("count") + (length - 1)).alias("end"))
    mixed = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest")).where("kinds > 1 and fewest = 1")
    wanted = split_join(kinds, mixed.select("h", "kinds", F.col("kinds").alias("rows")), "h", "rows")
    wanted = wanted.select("h", "kinds", (F.col("n") == 1).alias("alone"), "one.key", "one.tag", *unpacked("one.place"))
    few = _refined(_pieces(texts, wanted.where(F.col("kinds") <= crowded), length), length, gram)
    many = _refined_by_shuffle(_pieces(texts, wanted.where(F.col("kinds") > crowded), length), length)
    return settled.unionByName(few).unionByName(many)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None, with_kept: bool = False) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts anywhere else.

    Texts are UTF-8 bytes; matches never cross texts; overlaps of a text with itself count; strings are judged
    on the input, not on what is left.  Returns ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    runs), ``kept_sha256`` of the bytes that stay and, if asked for, the bytes themselves as ``kept``.

    The method is bucket-pointer refinement.  Initial buckets are those of ``gram``-byte strings.  Only one
    bucket is followed for each window, the least of those in it; a bucket with one member is final.  Blocks of
    neighbouring windows that share a bucket and a 64-bit hash of their content are equal as a whole.  Buckets whose
    blocks differ are refined window by window: sorted on the bucket ids at later offsets, each pass
    refining the buckets of the one before, until strings of ``length`` bytes are told apart, which are then compared
    byte by byte (in buckets of over ``CROWDED`` different blocks: by 128 bits, with a shuffle).

    A null text is empty.  Rows that repeat an id are separate texts, so a row given twice repeats itself.
    Null ids keep a row each; an empty table gives an empty result; further columns are not read.
    """
    gram = max(8, length - WINDOWS) if gram is None else gram
    if not 8 <= gram <= length <= gram + 254:
        raise ValueError(f"gram must be at least 8 and at most {length}, and within 254 of it, not {gram}")
    rows = keyed(docs, id_col, text_col)
    texts = packed(rows)
    spans = repeated_spans(rows, texts, length, gram)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept
        for few in sliced(parts, 500):
            sizes, gone, parts_gone, kept = [], [], [], []
            for z, (starts, ends) in zip(few.column(1).to_pylist(), span_arrays(few.column(2)), strict=True):
                body = opened(z)
                starts, ends = merged(starts, ends)
                sizes.append(len(body))
                gone.append(int((ends - starts).sum()))
                parts_gone.append(len(starts))
                kept.append(b"".join(body[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(body)], strict=True)))
            columns = [few.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(parts_gone, pa.int64()), pa.array([sha256(k).hexdigest() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_kept, names)

    return with_spans(texts, spans).mapInArrow(batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
