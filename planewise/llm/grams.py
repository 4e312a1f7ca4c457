"""Hashes of all substrings of fixed lengths, and the sampling that repeated substrings share."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


#: Places that ``anchored`` looks at together.
MOST = 1 << 23


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs."""
    x = a * K1
    x += b * K2
    x ^= x >> np.uint64(32)
    x *= K3
    x ^= x >> np.uint64(29)
    return x


def doubled(base: np.ndarray, length: int) -> np.ndarray:
    """Bucket ids of all runs of ``length`` entries: refined by pairing each bucket with the one that follows it.

    ``base`` identifies single entries; a bucket of 2q entries is the pair of the buckets of q entries at its
    start and q later, and the last step lets the two overlap.
    """
    ids, q = base, 1
    while q < length:
        step = min(q, length - q)
        ids = mix(ids[: len(ids) - step], ids[step:])
        q += step
    return ids


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, q = values, 1
    while q < width:
        step = min(q, width - q)
        out = np.minimum(out[: len(out) - step], out[step:])
        q += step
    return out


def anchored(ids: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` consecutive bucket ids, the place of the least; of equal ones the first.

    The choice depends on the ids alone, so the same content picks the same place wherever it stands.
    """
    n = len(ids) - width + 1
    low = np.uint64((1 << 24) - 1)
    out = np.zeros(max(n, 0), np.int64)
    for at in range(0, n, MOST):  # so many places fit in the low bits of a key
        part = ids[at : at + MOST + width - 1]
        keys = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        out[at : at + MOST] = (least(keys, width) & low).astype(np.int64) + at
    return out


def block_edges(anchors: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each block: neighbouring windows of one text with the same anchor.

    Text k has the windows from ``begin[k]`` up to, but without, ``end[k]``; each has one at least.
    """
    steps = np.zeros(len(anchors) + 1, np.int32)
    steps[begin] += 1
    np.subtract.at(steps, end, 1)
    inside = np.cumsum(steps[:-1]) > 0
    opens = inside.copy()
    opens[1:] &= (anchors[1:] != anchors[:-1]) | ~inside[:-1]
    opens[begin] = True
    closes = inside.copy()
    closes[:-1] &= opens[1:] | ~inside[1:]
    return np.flatnonzero(opens), np.flatnonzero(closes)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column end to end, and where each begins; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64, len(column) + 1, 8 * column.offset)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_ROOT = 0x5851F42D4C957F2D


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2**64."""
    out = []
    for base in (_ROOT, pow(_ROOT, -1, 1 << 64)):
        x = np.full(1 << bits, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def word_hashes(texts: list[bytes], chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts, in order, and the offsets of the texts' words in it.

    Words are what stands between ASCII white space.
    """
    hashes, counts = [], np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < chunk):
            size += len(texts[stop]) + 1
            stop += 1
        if size <= 4 * chunk:
            few, starts = _hash_words(b" ".join(texts[at:stop]))
            edges = np.cumsum([0] + [len(t) + 1 for t in texts[at:stop]])
            counts[at:stop] = np.diff(np.searchsorted(starts, edges))
            hashes.append(few)
        else:  # one long text, cut at white space
            text, low = texts[at], 0
            while low < len(text):
                found = SPACE.search(text, low + chunk)
                high = found.start() if found else len(text)
                few, _ = _hash_words(text[low:high])
                counts[at] += len(few)
                hashes.append(few)
                low = high
        at = stop
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


SPACE = re.compile(rb"[\x09-\x0d\x20]")


def _hash_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edges = np.diff(np.concatenate([[True], SPACES[data], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    up, down = _powers(max(18, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value, (ends - starts).astype(np.uint64)), starts
