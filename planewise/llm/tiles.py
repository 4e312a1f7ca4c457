"""Near-duplicate vectors by products of int8 tiles, with bounds of the rounding error."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import components, split_join, stored

#: Distinct vectors and components of a block, and rows of it that are multiplied at a time.
BLOCK, COMPONENTS, STRIP = 4096, 1 << 20, 512
#: Dimensions up to which a product of int8 vectors is a whole number that single precision holds exactly.
EXACT = (1 << 24) // 127**2
#: What double precision may lose in a bound.
SLACK = 1e-9

#: A block as a row: whose it is, and its vectors' nodes, row counts and unit vectors end to end.
_PACKED = pa.schema([("label", pa.int64()), ("dims", pa.int32()), ("blocks", pa.int32()), ("no", pa.int32()), ("nodes", pa.binary()), ("counts", pa.binary()), ("units", pa.binary())])


def sound(vector: Column) -> Column:
    """Whether an array of doubles has a direction: finite components only, and one that is not zero."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def normalised(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; they are scaled by their largest component first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, their scale, and the length of what rounding left out, a row for each unit vector."""
    scale = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    rest = units - codes * scale[:, None]
    return codes, scale, np.sqrt((rest * rest).sum(axis=1)) + SLACK


def maybe_near(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], cutoff: float) -> np.ndarray:
    """Which pairs may have a cosine of ``cutoff``: their coded product and the most that rounding can add reach it.

    With u = su*a + r and v = sv*b + s, the product uv differs from su*sv*ab by us + r(v - s), so by |s| + |r| (1 + |s|) at
    most.  Products of codes are whole numbers, summed exactly in single precision over ``EXACT`` dimensions at a time.
    """
    (a, sa, ra), (b, sb, rb) = left, right
    product = np.zeros((len(a), len(b)), np.float32 if a.shape[1] <= EXACT else np.float64)
    for at in range(0, a.shape[1], EXACT):
        product += a[:, at : at + EXACT].astype(np.float32) @ b[:, at : at + EXACT].astype(np.float32).T
    coded = product * sa[:, None] * sb[None, :]
    coded += ra[:, None] + rb[None, :] + ra[:, None] * rb[None, :] + SLACK
    return coded >= cutoff


def links(left: np.ndarray, right: np.ndarray, near: np.ndarray, cutoff: float) -> np.ndarray:
    """Which of the pairs marked in ``near`` do have the cosine, in double precision."""
    out = np.zeros_like(near)
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if 16 * np.count_nonzero(near) > len(rows) * len(columns):
        inside = np.ix_(rows, columns)
        out[inside] = near[inside] & (left[rows] @ right[columns].T >= cutoff)
        return out
    i, j = np.nonzero(near)
    for at in range(0, len(i), 1 << 16):
        few = slice(at, at + (1 << 16))
        out[i[few], j[few]] = np.einsum("ij,ij->i", left[i[few]], right[j[few]]) >= cutoff
    return out


class _Block:
    """The vectors of a block, as they come in a row of Arrow data."""

    def __init__(self, row: dict) -> None:
        self.nodes = np.frombuffer(row["nodes"], np.int64)
        self.counts = np.frombuffer(row["counts"], np.int64)
        self.units = np.frombuffer(row["units"], np.float64).reshape(len(self.nodes), -1)
        self.coded = quantised(self.units)


def _joined(root: np.ndarray, i: int, others: np.ndarray) -> None:
    """Put ``i`` and ``others`` into one set; ``root`` holds the least member of everyone's set."""
    met = np.unique(np.append(root[others], root[i]))
    if len(met) > 1:
        root[np.isin(root, met)] = met[0]


def compare(a: _Block, b: _Block, cutoff: float) -> pa.RecordBatch:
    """For each vector of two blocks that links with one of the other: how many rows it links with, and a member of its set.

    With ``b`` being ``a``, the block is compared with itself.  Sets are those that the links of these blocks make, so
    that as many edges as vectors leave the task, however many pairs link.
    """
    same, n = b is a, len(a.nodes)
    nodes = a.nodes if same else np.concatenate([a.nodes, b.nodes])
    shift = 0 if same else n
    found, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    for at in range(0, n, STRIP):
        strip = slice(at, at + STRIP)
        begin = at if same else 0  # of a block with itself, pairs from the diagonal on
        near = maybe_near(tuple(x[strip] for x in a.coded), tuple(x[begin:] for x in b.coded), cutoff)
        if same:
            near &= np.arange(near.shape[1])[None, :] > np.arange(near.shape[0])[:, None]
        if not near.any():
            continue
        near = links(a.units[strip], b.units[begin:], near, cutoff)
        found[at : at + len(near)] += near @ b.counts[begin:]
        found[shift + begin :][: near.shape[1]] += a.counts[strip] @ near
        for i in np.flatnonzero(near.any(axis=1)):
            _joined(root, at + i, shift + begin + np.flatnonzero(near[i]))
    hit = found > 0
    return pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(found[hit]), pa.array(nodes[root[hit]])], ["node", "links", "met"])


def _pack(own: pa.Table) -> pa.Table:
    """The vectors of one block as a row."""
    own = own.sort_by("node")
    x = own.column("vec").combine_chunks()
    units = normalised(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1))
    data = (*(own.column(c).to_numpy().astype(np.int64) for c in ("node", "n")), units)
    return pa.table([*([own.column(c)[0].as_py()] for c in _PACKED.names[:4]), *([d.tobytes()] for d in data)], schema=_PACKED)


def near_duplicates(vectors: DataFrame, cutoff: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id`` and ``kept`` (it is the least of its component).

    Two vectors link if their labels are equal and their cosine, in double precision, is ``cutoff`` or more.
    ``n_links`` counts the other vectors that one links with; ``component_id`` is the smallest id reachable over links.
    All pairs of a label are compared: its distinct vectors are dealt to blocks of about ``block`` by a hash, each pair of
    blocks is a task's unit of work, and of the pairs in it those are computed in double precision that
    the product of their int8 codes, with a rigorous bound of each vector's rounding error, leaves possible.  Equal
    vectors are one vector with a count.  No pair leaves its task: only counts and a set's member for each vector do.

    A row with a null label links with nothing, nor does a vector that is null, zero or holds a null or non-finite component;
    vectors of different length do not link.  Rows that repeat an id are vectors of their own, which share a component
    if they are linked; a null id keeps its row and names a component only where no other id is.  An empty table gives
    an empty result; further columns of the input are not read.
    """
    vector = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vec"))
    rows = rows.withColumn("usable", F.col("label").isNotNull() & sound(F.col("vec")))
    classes = rows.where("usable").groupBy("label", "vec").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    # vectors of one length make the blocks: a cosine needs the same
    sizes = classes.groupBy("label", F.size("vec").alias("dims")).agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("weight", F.col("size")).withColumn("blocks", F.ceil(F.col("size") * F.greatest(F.lit(1 / block), F.col("dims") / COMPONENTS)).cast("int"))
    dealt = split_join(classes.withColumn("dims", F.size("vec")), sizes.select("label", "dims", "blocks", "weight"), ["label", "dims"], "weight")
    dealt = dealt.withColumn("no", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int"))

    packed = dealt.groupBy("label", "dims", "no").applyInArrow(_pack, "label long, dims int, blocks int, no int, nodes binary, counts binary, units binary")
    # each block meets every block of its label once: a pair of blocks has two rows, a block with itself one
    meets = packed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    meets = meets.select("label", "dims", F.least("no", "other").alias("low"), F.greatest("no", "other").alias("high"), "nodes", "counts", "units")

    def tile(pair: pa.Table) -> pa.Table:
        both = [_Block(r) for r in pair.select(["nodes", "counts", "units"]).to_pylist()]
        return pa.Table.from_batches([compare(both[0], both[-1], cutoff)])

    met = stored(meets.groupBy("label", "dims", "low", "high").applyInArrow(tile, "node long, links long, met long"))
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("node").alias("u"), F.col("met").alias("v")))
    known = classes.join(counts, "node", "left").join(roots, "node", "left")
    known = stored(known.select("label", "vec", "least", "n", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("root", "node").alias("root")))
    named = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    named = split_join(known, named, "root", "size")
    named = named.select("label", "vec", F.col("n").alias("weight"), (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    linked = split_join(rows.where("usable").select("id", "label", "vec"), named, ["label", "vec"], "weight")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.expr("id <=> component_id").alias("kept"))


#: The same over ``embeddings`` in SQL.
ORACLE = """
with recursive v as (select vec_id, label, embedding::double[] as e, vec_id as seen from embeddings),
s as (select * from v where label is not null and len(e) > 0 and list_bool_and([coalesce(isfinite(x), false) for x in e]) and list_bool_or([x <> 0 for x in e])),
n as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as size from s),
p as (select a.vec_id as u, b.vec_id as w from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) / a.size / b.size >= 0.98),
r as (select vec_id, seen from v union select r.vec_id, p.w from r join p on r.seen = p.u),
c as (select vec_id, min(seen) as component_id from r group by vec_id),
k as (select u, count(*) as n_links from p group by u)
select c.vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, c.vec_id = component_id as kept from c left join k on c.vec_id = k.u
"""
