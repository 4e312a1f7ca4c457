"""Approximate nearest neighbours: inverted lists of coarse centroids, product-quantised residuals with error bounds, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import stored

#: Bound of the sample that the model is fitted on, and of the queries that are answered from all rows to calibrate the probes.
SAMPLE, PROBE_QUERIES = 40_000, 200
#: Share of those queries' true answers that lie in the probed lists.
TARGET = 0.98
#: Sampled vectors that a list needs; parts of a residual, and codes of each.
PER_LIST, PARTS, CODES = 8, 16, 256
#: Members of a list's unit, and of a group; queries that are scored together.
UNIT, GROUP, TOGETHER = 2048, 4096, 128
#: Bound of the rounding of an inner product in double precision, as a share of the product of the lengths.
ROUNDING = 1e-12
#: Shares of a list's radius that may count when lists are ordered for a query.
REACHES = (0.0, 0.25, 0.5, 1.0)


@dataclass(frozen=True)
class Model:
    """Coarse ``centroids`` and a codebook for each part of the residuals."""

    centroids: np.ndarray
    books: tuple[np.ndarray, ...]
    cuts: tuple[int, ...]

    def lists(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centroids)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[lists]
        parts = np.split(rest, self.cuts, axis=1)
        return np.stack([_nearest(p, b) for p, b in zip(parts, self.books, strict=True)], axis=1).astype(np.uint8)

    def errors(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far a vector is from what its list and code say, at most: times a query's length, a bound of a score's error."""
        said = self.centroids[lists] + np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)
        lengths = [np.linalg.norm(v, axis=1) for v in (x - said, x, self.centroids[lists])]
        return lengths[0] + 4 * ROUNDING * (lengths[1] + 2 * lengths[2])


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(axis=1)
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (x[at : at + 4096] @ centres.T - half).argmax(axis=1)
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of at most ``k`` clusters; starts from distinct points, evenly spaced in sorted order."""
    points = np.unique(x, axis=0)
    k = max(1, min(k, len(points)))
    order = np.random.default_rng(7).permutation(len(points))[:k]
    centres = points[order].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        sizes = np.bincount(near, minlength=k)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
    return centres


def fit(sample: np.ndarray, total: int) -> Model:
    """Fit on a bounded sample: about the square root of ``total`` lists."""
    lists = int(min(max(1, round(total**0.5)), max(1, len(sample) // PER_LIST)))
    centres = _kmeans(sample, lists)
    near = _nearest(sample, centres)
    cuts = tuple(np.cumsum([len(p) for p in np.array_split(np.arange(sample.shape[1]), min(PARTS, sample.shape[1]))])[:-1].tolist())
    books = tuple(_kmeans(p, CODES, 5) for p in np.split(sample - centres[near], cuts, axis=1))
    return Model(centres, books, cuts)


def _true_lists(index: DataFrame, asks: pa.Table, k: int) -> list[tuple[int, int]]:
    """The place of each of a few queries with the list of each of its ``k`` true answers, from one pass over all rows."""
    q_ids, q = asks.column("id").to_numpy(), _matrix(asks.column("vec").combine_chunks())

    def best(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int32)]
        for part in parts:
            ids, lists = part.column(0).to_numpy(), part.column(2).to_numpy()
            score = q @ _matrix(part.column(1)).T
            score[q_ids[:, None] == ids[None, :]] = -np.inf
            held = [np.concatenate([h, np.broadcast_to(n, score.shape)], axis=1) for h, n in zip(held, (score, ids, lists), strict=True)]
            if held[0].shape[1] > k:
                top = np.argpartition(-held[0], k - 1, axis=1)[:, :k]
                held = [np.take_along_axis(h, top, axis=1) for h in held]
        at, col = np.nonzero(held[0] > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(h[at, col]) for h in held)], ["q", "score", "id", "list"])

    found = index.select("id", "vec", "list").mapInArrow(best, "q long, score double, id long, list int")
    ranked = found.selectExpr("q", "list", "row_number() over (partition by q order by score desc, id) as r").where(F.col("r") <= k)
    return [(r["q"], r["list"]) for r in ranked.collect()]


def _order(model: Model, q: np.ndarray, radii: np.ndarray, reach: float) -> np.ndarray:
    """The lists in the order in which each query visits them: by the score of the centroid, and of what lies around it."""
    return np.argsort(-(q @ model.centroids.T + reach * np.linalg.norm(q, axis=1)[:, None] * radii), axis=1, kind="stable")


def _calibrate(model: Model, q: np.ndarray, true: list[tuple[int, int]], counts: np.ndarray, radii: np.ndarray) -> tuple[float, int]:
    """The share of radii and the number of lists with which ``TARGET`` of the true answers are visited at the least cost."""
    choices = []
    for reach in REACHES:
        order = _order(model, q, radii, reach)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        need = np.sort([place[i, c] for i, c in true]) if true else np.zeros(1, np.int64)
        probes = int(need[int(np.ceil(TARGET * len(need))) - 1]) + 1
        choices.append((float(counts[order[:, :probes]].sum()), reach, probes))
    return min(choices)[1:]


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id`` and ``vec`` (doubles) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    sound: Column = F.expr("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    return rows.where("id is not null and vec is not null").where(F.coalesce(sound, F.lit(False)))


def _once(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` without those that no query can be given: of a vector with over ``UNIT`` rows, all but the ``k`` + 1 smallest ids.

    All of its rows are equally near to any query, and ties go to the smaller id.  There are fewer such vectors than one
    for every ``UNIT`` rows, so their hashes are broadcast, and nothing else is shuffled.
    """
    hashed = rows.withColumn("h", F.xxhash64("vec"))
    often = F.broadcast(hashed.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > UNIT).select("h"))
    crowd = hashed.join(often, "h", "left_semi").select("id", "vec").distinct()
    crowd = crowd.selectExpr("id", "vec", "row_number() over (partition by vec order by id) as r").where(F.col("r") <= k + 1)
    return hashed.join(often, "h", "left_anti").select("id", "vec").unionByName(crowd.select("id", "vec"))


def nearest(vectors: DataFrame, every: int, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For every row whose id is divisible by ``every``, the ``k`` rows with the largest inner product that were found.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, the inner product of the original vectors in
    double precision; ties go to the smaller id.  All rows but the query's own id are indexed: each lies in the
    list of its nearest centroid, as product-quantised residual with the length of what the code leaves out.  A query
    visits the lists nearest to it, at least enough to hold ``k`` others; asymmetric distance tables bound the scores of a
    list's members, and all that may be among the best are scored exactly, so that nothing is missed in the lists
    visited.  Lists are cut into units of bounded size and these dealt to groups, so a crowded list is searched by
    many tasks; of a vector given very often, only the smallest ids are indexed, as no other can be an answer.

    How many lists are visited, and how much a list's radius counts in their order, is found from at most
    ``PROBE_QUERIES`` of the queries, picked by a hash, whose true answers are taken from all rows in one pass: ``TARGET``
    of those answers lie in the lists visited.  So recall rests on the queries and rows given, not on their kind; where
    lists tell little, as among vectors without any structure, most of them are visited.

    The model is fitted on at most ``SAMPLE`` vectors, picked by a hash.  Lists are about the square root of the rows, at
    most one for every ``PER_LIST`` sampled vectors; beyond that, lists get longer and a query's work grows with
    the rows, until ``SAMPLE`` is raised.  Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do rows without an id or vectors of another length than most.  Rows that repeat an id are separate
    candidates, unless the whole row repeats, and one query; the smallest vector asks.
    """
    rows = usable(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    kind = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return rows.sparkSession.createDataFrame([], kind)
    dims, total = sizes[0]["d"], sizes[0]["n"]
    rows = rows.where(F.size("vec") == dims)
    share = int(min(1.0, 1.3 * SAMPLE / total) * (1 << 30))
    few = rows.withColumn("h", F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30))).where(F.col("h") < share)
    picked = few.orderBy("h", "id", "vec").limit(SAMPLE).select("vec").toArrow().column("vec").combine_chunks()
    model = fit(_matrix(picked), total)

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _matrix(part.column(1))
            lists = model.lists(x)
            codes = model.codes(x, lists)
            radius = np.linalg.norm(x - model.centroids[lists], axis=1)
            columns = [part.column(0), part.column(1), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(model.errors(x, lists, codes)), pa.array(radius)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "vec", "list", "code", "error", "radius"])

    index = stored(_once(rows, k).mapInArrow(assign, "id long, vec array<double>, list int, code binary, error double, radius double"))
    counts, radii = np.zeros(len(model.centroids), np.int64), np.zeros(len(model.centroids))
    for r in index.groupBy("list").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).collect():  # a row for each list
        counts[r["list"]], radii[r["list"]] = r["n"], r["radius"]
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    tried = queries.orderBy(F.xxhash64("id", "vec"), "id").limit(PROBE_QUERIES).toArrow()
    if not tried.num_rows:
        return rows.sparkSession.createDataFrame([], kind)
    reach, probes = _calibrate(model, _matrix(tried.column("vec").combine_chunks()), _true_lists(index, tried, k), counts, radii)
    groups = max(1, -(-int(counts.sum()) // GROUP))
    units = np.maximum(1, -(-counts // UNIT))
    # the groups that hold list i are those from ends[i - 1] to ends[i] in ``held_by``
    spread = np.minimum(units, groups)
    ends = np.cumsum(spread)
    held_by = ((np.repeat(np.arange(len(units)) * 7919, spread) + np.arange(ends[-1]) - np.repeat(ends - spread, spread)) % groups).astype(np.int32)

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _matrix(part.column(1))
            order = _order(model, x, radii, reach)
            held = np.cumsum(counts[order], axis=1)
            # one of those held may be the query itself, or more if its id repeats
            enough = np.maximum(probes, (held < 4 * k).sum(axis=1) + 1)
            visits = np.zeros(order.shape, bool)
            np.put_along_axis(visits, order, np.arange(order.shape[1])[None, :] < enough[:, None], axis=1)
            each = [np.unique(np.concatenate([held_by[ends[i] - spread[i] : ends[i]] for i in np.flatnonzero(v)])) for v in visits]
            q, g = np.repeat(np.arange(len(each)), [len(e) for e in each]), np.concatenate([np.zeros(0, np.int32), *each])
            masks = np.packbits(visits, axis=1)
            columns = [pa.array(g.astype(np.int32)), part.column(0).take(pa.array(q)), part.column(1).take(pa.array(q)), pa.array([masks[i].tobytes() for i in q], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["g", "id", "vec", "visits"])

    asked = queries.mapInArrow(ask, "g int, id long, vec array<double>, visits binary")
    table = rows.sparkSession.createDataFrame([(i, int(u)) for i, u in enumerate(units.tolist())], "list int, units long")
    index = index.join(table, "list")
    unit = F.pmod(F.xxhash64("id", "vec"), F.col("units"))
    members = index.withColumn("g", ((F.col("list").cast("long") * 7919 + unit % groups) % groups).cast("int"))
    members = members.select("g", "id", "vec", "list", "code", "error")

    def search(own: pa.Table, asks: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if own.num_rows and asks.num_rows:
            own = own.sort_by("id").combine_chunks()
            ids, lists = own.column("id").to_numpy(), own.column("list").to_numpy()
            x = _matrix(own.column("vec").combine_chunks())
            codes = np.frombuffer(b"".join(own.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            for at in range(0, asks.num_rows, TOGETHER):
                few = asks.slice(at, TOGETHER)
                _score(model, (ids, lists, x, codes, own.column("error").to_numpy()), few, k, found)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query_id", "vec_id", "score"])

    hits = members.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(search, "query_id long, vec_id long, score double")
    ranked = hits.selectExpr("query_id", "row_number() over (partition by query_id order by score desc, vec_id) as rank", "vec_id", "score")
    return ranked.where(F.col("rank") <= k)


def _possible(near: np.ndarray, errors: np.ndarray, open_to: np.ndarray, k: int) -> np.ndarray:
    """Of the members ``open_to`` each query, those that may be among its ``k`` best, from scores and how far these may be off."""
    least = np.where(open_to, near - errors, -np.inf)
    at = least.shape[1] - k
    floor = np.partition(least, at, axis=1)[:, at] if at > 0 else np.full(len(least), -np.inf)
    return open_to & (near + errors >= floor[:, None])


def _score(model: Model, own: tuple[np.ndarray, ...], asks: pa.Table, k: int, found: list[list]) -> None:
    """The best ``k`` members of a group for each of some queries, among those in lists that the query visits."""
    ids, lists, x, codes, errors = own
    q_ids, q = asks.column("id").to_numpy(), _matrix(asks.column("vec").combine_chunks())
    masks = np.frombuffer(b"".join(asks.column("visits").to_pylist()), np.uint8).reshape(len(q), -1)
    visits = np.unpackbits(masks, axis=1, count=len(model.centroids)).astype(bool)
    lengths = np.linalg.norm(q, axis=1)[:, None]
    near = (q @ model.centroids.T)[:, lists]
    for j, (part, book) in enumerate(zip(np.split(q, model.cuts, axis=1), model.books, strict=True)):
        near += (part @ book.T)[:, codes[:, j]]
    possible = _possible(near, lengths * errors, visits[:, lists] & (q_ids[:, None] != ids[None, :]), k)
    some = np.flatnonzero(possible.any(axis=0))
    if not len(some):
        return
    # codes leave many possible where vectors have no structure: bound those once more, by their products
    ids, x = ids[some], x[some]
    possible = _possible(q @ x.T, ROUNDING * lengths * np.linalg.norm(x, axis=1), possible[:, some], k)
    for i in range(len(q)):
        at = np.flatnonzero(possible[i])
        exact = (x[at] * q[i]).sum(axis=1)
        best = np.lexsort((ids[at], -exact))[:k]
        found[0] += [int(q_ids[i])] * len(best)
        found[1] += ids[at[best]].tolist()
        found[2] += exact[best].tolist()
