"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import checkpoint, components, split_join, tasks

BITS = 64
SEED = 42
#: Texts that a worker holds as Python strings at a time.
SLICE = 256


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text, as a signed number: a bit is 1 if over half of the shingles' XXH64 set it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths) - 1
        starts = (ends - lengths + 1)[: len(words) - width + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id`` and signed 64-bit ``fp`` of every row, computed in Arrow batches."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, SLICE):
                few = part.slice(at, SLICE)
                fps = np.fromiter((fingerprint(t, width) for t in few.column(1).to_pylist()), np.int64, few.num_rows)
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(batches, "id long, fp long")


def _one_wildcard(fp: str) -> str:
    """Two segments of 32 bits, each with one bit left out in turn: 64 keys, tagged by segment and bit.

    Fingerprints that differ in two bits differ in at most one bit in one of the two segments, so they share a key.
    """
    low = f"(shiftleft(cast(j as bigint), 32) | (({fp} & 4294967295L) & ~shiftleft(1L, j)))"
    high = f"(shiftleft(cast(j + 32 as bigint), 32) | (shiftrightunsigned({fp}, 32) & ~shiftleft(1L, j)))"
    return f"flatten(transform(sequence(0, 31), j -> array({low}, {high})))"


def links(distinct: DataFrame) -> DataFrame:
    """Edges ``u``, ``v`` that connect the distinct fingerprints ``fp`` as all pairs at two bits or fewer would.

    The one-wildcard keys are grouped, with partial counts.  The two members of a group of two are verified as a
    pair.  Larger groups, such as near copies of one text make, would have a square of pairs; their members are
    told apart further by the same idea on the whole fingerprint: each is entered under itself and under
    its 64 one-bit variants.  Two fingerprints share an entry if and only if they differ in two bits or fewer, and
    an entry has at most 65 members, so those are chained to their least without a pair being spelled out.
    """
    n = tasks(distinct.sparkSession)
    keys = distinct.repartition(n, "fp").select("fp", F.explode(F.expr(_one_wildcard("fp"))).alias("key"))
    groups = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    groups = checkpoint(groups.where("n > 1"))
    pairs = groups.where("n = 2 and bit_count(a ^ b) <= 2").select(F.col("a").alias("u"), F.col("b").alias("v"))
    many = split_join(keys, groups.where("n > 2").select("key", "n"), "key", "n").select("fp").distinct()
    entries = "concat(array(fp), transform(sequence(0, 63), j -> fp ^ shiftleft(1L, j)))"
    entered = many.repartition(n, "fp").select("fp", F.explode(F.expr(entries)).alias("entry"))
    near = entered.groupBy("entry").agg(F.sort_array(F.collect_list("fp")).alias("all"))  # 65 at most
    chain = near.where("size(all) > 1").select(F.explode(F.expr("transform(slice(all, 2, 64), x -> struct(x as u, all[0] as v))")).alias("e"))
    return pairs.unionByName(chain.select("e.u", "e.v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` and ``fp_links``.

    Texts are lower-cased in A-Z and split at ASCII white space; a bit of the fingerprint is 1 if it is set in
    over half of the XXH64 values of all ``width``-word shingles, repeats included.  Fingerprints link at two or
    fewer differing bits, found by one-wildcard variants of two segments where two fingerprints share a variant, and by those of the
    whole fingerprint where more do; ``component_id`` is the smallest id reachable.  Copies share a fingerprint and are
    handled once.  ``fp_links`` counts the rows that share the row's fingerprint, itself included.

    A null or empty text has no words and the fingerprint zero, which links like any other.  Rows that repeat
    an id keep a row each.  A null id keeps its row and never names a component unless all ids in it are null.
    An empty table gives an empty result; further columns of the input are not read.
    """
    fps = checkpoint(fingerprints(docs, id_col, text_col, width))
    classes = checkpoint(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    roots = components(links(classes.select("fp")))
    rooted = checkpoint(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    named = split_join(rooted, named, "root", "size").select("fp", "component_id", "n", F.col("n").alias("fp_links"))
    out = split_join(fps, named, "fp", "n")
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp_links")
