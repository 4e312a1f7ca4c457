"""Signed ranks and Walsh medians of any number of paired differences, and bootstrap draws dealt to tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planewise.functions.columns import ratio
from planewise.functions.storage import written
from planewise.operators.selection import part_starts, ranges, same

#: Distinct values of a block; bounds that a round of the search tries for each rank; draws of a task.
BLOCK, TRIED, DRAWS = 1 << 16, 15, 1 << 24
#: Values that draws are made from: each task that draws holds them all, at 8 bytes.
MOST_DRAWN = 1 << 27


def signed_ranks(pairs: DataFrame, parts: int | None = None) -> DataFrame:
    """Of each metric's differences that are not zero: ``n``, ``n_sizes`` different sizes, ``up``, the sum of the ranks
    of the positive ones, ``down``, that of the others, and ``ties``, the sum of t**3 - t over sizes that t differences share.

    Sizes are counted and dealt by ranges, so ranks are sums over the parts before and in the own one.  Ranks that
    are shared are averaged.
    """
    sizes = pairs.where("diff <> 0").groupBy("metric", F.abs("diff").alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("diff") > 0).alias("n_up"))
    dealt = ranges(sizes, ("metric", "size"), parts)
    starts = part_starts(dealt, ("metric",), {}).select("metric", "part", "before")
    upto = F.sum("n").over(Window.partitionBy("metric", "part").orderBy("size"))
    # twice the averaged rank, a whole number
    ranked = same(dealt.withColumn("upto", upto), starts, ("metric", "part"), "inner").withColumn("twice", 2 * (F.col("before") + F.col("upto")) - F.col("n") + 1)
    n, wide = F.col("n").cast("decimal(38,0)"), F.col("twice").cast("decimal(38,0)")
    out = ranked.groupBy("metric").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_sizes"), (F.sum(wide * F.col("n_up")) / 2).cast("double").alias("up"),
        (F.sum(wide * (F.col("n") - F.col("n_up"))) / 2).cast("double").alias("down"), F.sum(n * n * n - n).cast("double").alias("ties"),
    )
    return out


def rank_biserial(ranks: DataFrame) -> DataFrame:
    """(W+ - W-) / (W+ + W-) from ``signed_ranks``."""
    return ranks.select("metric", ratio(F.col("up") - F.col("down"), F.col("up") + F.col("down")).alias("rank_biserial"))


# The median of pair means.  A double's place among all doubles is a whole number, so halving a range of them ends.


def place_of(x: float) -> int:
    """The place of a double: larger doubles have larger places, and neighbours differ by one."""
    bits = int(np.float64(x + 0.0).view(np.int64))
    return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)


def at_place(place: int) -> float:
    return float(np.int64(place).view(np.float64)) if place >= 0 else -float(np.int64(-place).view(np.float64))


def _upto(values: np.ndarray, own: np.ndarray, bound: float) -> np.ndarray:
    """For each of ``own``, how many of the sorted ``values`` make a sum of at most ``bound`` with it, as doubles are added."""
    at = np.searchsorted(values, bound - own, "right")
    while True:  # the difference may be rounded: mend by the sums themselves
        more = (at < len(values)) & (own + values[np.minimum(at, len(values) - 1)] <= bound)
        less = (at > 0) & (own + values[np.maximum(at - 1, 0)] > bound)
        if not (more.any() or less.any()):
            return at
        at = at + more.astype(np.int64) - less.astype(np.int64)


def pairs_upto(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], bound: float) -> int:
    """Ordered pairs of a difference of ``a`` and one of ``b``, as values with counts, that add up to at most ``bound``."""
    total = np.concatenate([[0], np.cumsum(b[1])])
    return int((a[1] * total[_upto(b[0], a[0], bound)]).sum())  # below 2**63 up to three billion differences


def twice_upto(values: np.ndarray, counts: np.ndarray, bound: float) -> int:
    """Differences that add up to at most ``bound`` with themselves."""
    return int(counts[values + values <= bound].sum())


def walsh_median(values: np.ndarray, counts: np.ndarray) -> float | None:
    """Median of the means of all pairs of sorted ``values`` with ``counts``, each difference with itself too; in one task."""
    n = int(counts.sum())
    if not n:
        return None
    total = n * (n + 1) // 2

    def count(bound: float) -> int:
        return (pairs_upto((values, counts), (values, counts), bound) + twice_upto(values, counts, bound)) // 2

    def sum_of_rank(k: int) -> float:
        low, high = place_of(2 * values[0]) - 1, place_of(2 * values[-1])
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if count(at_place(middle)) <= k else (low, middle)
        return at_place(high)

    return (sum_of_rank((total - 1) // 2) + sum_of_rank(total // 2)) / 4


class _Blocks:
    """What the driver knows of a metric's blocks, in order: first and last value and differences of each; a row for ``BLOCK`` values."""

    def __init__(self, rows: list) -> None:
        self.names = [(r["part"], r["no"]) for r in rows]
        self.first, self.last = (np.array([r[c] for r in rows]) for c in ("first", "last"))
        self.n = np.array([r["n"] for r in rows], object)
        self.upto = np.concatenate([[0], np.cumsum(self.n)])
        size = int(self.upto[-1])
        total = size * (size + 1) // 2
        ends = (place_of(2 * self.first[0]) - 1, place_of(2 * self.last[-1]))
        self.ranges = {k: ends for k in ((total - 1) // 2, total // 2)}

    def whole(self, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """For each block, how many of the first blocks add up to at most ``bound`` with it as a whole, and how many in part."""
        return _upto(self.last, self.last, bound), _upto(self.first, self.first, bound)

    def tried(self) -> list[int]:
        """The bounds of the next round, evenly spaced in every range that is still open."""
        return sorted({low + (high - low) * i // (TRIED + 1) for low, high in self.ranges.values() if high - low > 1 for i in range(1, TRIED + 1)} - {low for low, _ in self.ranges.values()})

    def narrow(self, counts: dict[int, tuple[int, int]]) -> None:
        """Move the ends of each range: of each bound at least, and at most, so many pairs are known to be within it."""
        for k, (low, high) in self.ranges.items():
            low = max([low, *(p for p, (_, most) in counts.items() if most <= k)])
            high = min([high, *(p for p, (least, _) in counts.items() if least > k)])
            self.ranges[k] = (low, high)

    def outline(self) -> None:
        """Narrow the ranges by the blocks' ends alone."""
        while True:
            before = dict(self.ranges)
            counts = {}
            for p in self.tried():
                whole, part = self.whole(at_place(p))
                least, most = (int((self.n * self.upto[x]).sum()) for x in (whole, part))
                counts[p] = (least // 2, (most + int(self.upto[-1])) // 2)
            self.narrow(counts)
            if before == self.ranges:
                return


def _packed(dealt: DataFrame, block: int) -> DataFrame:
    """Values and counts of a metric in blocks of bounded size."""

    def pack(own: pa.Table) -> pa.Table:
        own = own.sort_by("value")
        value, n = own.column("value").to_numpy(), own.column("n").to_numpy()
        row = [own.column(c)[0].as_py() for c in ("metric", "part", "no")] + [value[0], value[-1], int(n.sum()), len(n), value.tobytes(), n.astype(np.int64).tobytes()]
        return pa.table([[v] for v in row], schema=kind)

    kind = pa.schema([("metric", pa.string()), ("part", pa.int32()), ("no", pa.int64()), ("first", pa.float64()), ("last", pa.float64()), ("n", pa.int64()), ("size", pa.int64()), ("values", pa.binary()), ("counts", pa.binary())])
    numbered = dealt.withColumn("no", F.floor((F.row_number().over(Window.partitionBy("metric", "part").orderBy("value")) - 1) / block))
    return numbered.groupBy("metric", "part", "no").applyInArrow(pack, "metric string, part int, no long, first double, last double, n long, size long, values binary, counts binary")


def _arrays(row: dict, end: str = "") -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row[f"values{end}"], np.float64), np.frombuffer(row[f"counts{end}"], np.int64)


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered pairs of two blocks within each bound that is asked for; of a block with itself, also its differences doubled."""
    for part in parts:
        for r in part.to_pylist():
            a, b = _arrays(r), _arrays(r, "_b")
            found = [pairs_upto(a, b, at_place(p)) + (twice_upto(*a, at_place(p)) if r["own"] else 0) for p in r["places"]]
            yield pa.RecordBatch.from_arrays([pa.array([r["metric"]] * len(found), pa.string()), pa.array(r["places"], pa.int64()), pa.array(found, pa.int64())], ["metric", "place", "found"])


def hodges_lehmann(pairs: DataFrame, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """Median of the means of all pairs of a metric's differences, each with itself too, without a list of pairs.

    Differences are counted, dealt by ranges and packed in blocks.  A metric of at most ``block`` different ones is one task.
    For the others a search over all doubles narrows, by ``TRIED`` bounds a round, the range of the sum in the middle: two
    blocks whose ends tell on which side of a bound their sums lie are counted from their sizes, the few others, along one
    line through the table of blocks, are counted by the tasks that get both.  A round ends with a number for each metric and bound.
    """
    spark = pairs.sparkSession
    differences = pairs.groupBy("metric", (F.col("diff") + F.lit(0.0)).alias("value")).agg(F.count("*").alias("n"))
    held = written(_packed(ranges(differences, ("metric", "value"), parts), block))
    sizes = held.groupBy("metric").agg(F.sum("size").alias("all"))
    small = same(held, sizes.where(F.col("all") <= block).select("metric"), ("metric",), "left_semi")

    def one(own: pa.Table) -> pa.Table:
        rows = own.sort_by("first").to_pylist()
        values, counts = (np.concatenate(c) for c in zip(*(_arrays(r) for r in rows), strict=True))
        return pa.table({"metric": pa.array([rows[0]["metric"]], pa.string()), "hl_shift": pa.array([walsh_median(values, counts)], pa.float64())})

    out = small.groupBy("metric").applyInArrow(one, "metric string, hl_shift double")
    large = same(held, sizes.where(F.col("all") > block).select("metric"), ("metric",), "left_semi")
    ends = large.select("metric", "part", "no", "first", "last", "n").orderBy("metric", "first").collect()  # a row for each block
    if not ends:
        return out
    search = {m: _Blocks([r for r in ends if r["metric"] == m]) for m in {r["metric"] for r in ends}}
    for s in search.values():
        s.outline()
    while any(s.tried() for s in search.values()):
        _round(spark, held, search)
    found = [(m, sum(at_place(high) for _, high in (s.ranges[min(s.ranges)], s.ranges[max(s.ranges)])) / 4) for m, s in search.items()]
    return out.unionByName(spark.createDataFrame(found, "metric string, hl_shift double"))


def _round(spark: SparkSession, held: DataFrame, search: dict[str, _Blocks]) -> None:
    """Count the pairs within the next bounds of every metric, and narrow its ranges."""
    known: dict[str, dict[int, int]] = {}
    asked: dict[tuple, list[int]] = {}
    for m, s in search.items():
        known[m] = {}
        for p in s.tried():
            whole, part = s.whole(at_place(p))
            known[m][p] = int((s.n * s.upto[whole]).sum())
            for i, (low, high) in enumerate(zip(whole.tolist(), part.tolist(), strict=True)):
                for j in range(low, high):
                    asked.setdefault((m, *s.names[i], *s.names[j]), []).append(p)
                if i < low:  # a block that is within the bound as a whole is so with itself
                    known[m][p] += int(s.n[i])
    if asked:
        rows = [(*k, places) for k, places in asked.items()]
        table = spark.createDataFrame(rows, "metric string, part int, no long, part_b int, no_b long, places array<long>")
        second = held.select(F.col("metric").alias("metric"), F.col("part").alias("part_b"), F.col("no").alias("no_b"), F.col("values").alias("values_b"), F.col("counts").alias("counts_b"))
        both = table.join(held.select("metric", "part", "no", "values", "counts"), ["metric", "part", "no"]).join(second, ["metric", "part_b", "no_b"])
        both = both.withColumn("own", (F.col("part") == F.col("part_b")) & (F.col("no") == F.col("no_b")))
        for r in both.mapInArrow(_counted, "metric string, place long, found long").groupBy("metric", "place").agg(F.sum(F.col("found").cast("decimal(38,0)")).alias("found")).collect():
            known[r["metric"]][r["place"]] += int(r["found"])
    for m, s in search.items():
        s.narrow({p: (n // 2, n // 2) for p, n in known[m].items()})


# Draws


def accepted(seed: int, first: int, size: int, n: int) -> np.ndarray:
    """The places below ``n`` that a seeded generator draws, from ``size`` of its 32-bit numbers, the one at ``first`` on.

    A number stands for the upper half of its product with ``n``; those whose lower half is under 2**32 mod n are passed over, so
    that every place is as likely.  Which are passed over does not depend on those before, so any part of the stream can be made.
    """
    source = np.random.PCG64(seed)
    source.advance(first // 2)
    words = source.random_raw(-(-(first % 2 + size) // 2))
    halves = np.empty(2 * len(words), np.uint64)
    halves[0::2], halves[1::2] = words & np.uint64(0xFFFFFFFF), words >> np.uint64(32)
    products = halves[first % 2 :][:size] * np.uint64(n)
    return (products >> np.uint64(32))[(products & np.uint64(0xFFFFFFFF)) >= np.uint64((1 << 32) % n)].astype(np.int64)


def passed_over(seed: int, first: int, size: int, n: int, step: int = 1 << 20) -> int:
    """How many of the numbers from ``first`` on are no draw."""
    return sum(min(step, size - at) - len(accepted(seed, first + at, min(step, size - at), n)) for at in range(0, size, step)) if (1 << 32) % n else 0


def medians(values: np.ndarray, seed: int, row: int, rows: int, skipped: int) -> np.ndarray:
    """Medians of the resamples from ``row`` on, of a stream of which ``skipped`` numbers before them are no draws."""
    n = len(values)
    if n == 1:
        return np.repeat(values, rows)
    out, at = [], row * n
    left = np.zeros(0, np.int64)
    few = max(1, (1 << 21) // n)
    while len(out) < rows:
        more = accepted(seed, at, few * n, n)
        at += few * n
        drop = min(skipped, len(more))
        skipped -= drop
        left = np.concatenate([left, more[drop:]])
        whole = min(len(left) // n, rows - len(out))
        if whole:
            out.extend(np.median(values[left[: whole * n]].reshape(whole, n), axis=1).tolist())
            left = left[whole * n :]
    return np.array(out)


def bootstrap_intervals(table: DataFrame, group: str, order: tuple[str, ...], value: str, n_boot: int = 10000, alpha: float = 0.05, seed: int = 0, draws: int = DRAWS) -> DataFrame:
    """``ci_lo`` and ``ci_hi``, the percentile interval of the median of each group's finite values; groups of one value have none.

    Resamples are those of one seeded generator that draws places among the values in their ``order``, whatever their dealing: a
    task makes a range of them, from where they are in the stream.  First the numbers that are no draws are counted.  A group's values go
    to each of its tasks, at most ``MOST_DRAWN`` of 8 bytes.
    """
    finite = table.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))

    def pack(own: pa.Table) -> pa.Table:
        own = own.sort_by([(c, "ascending") for c in order])
        if own.num_rows > MOST_DRAWN:
            raise ValueError(f"{own.column(group)[0]}: more than {MOST_DRAWN} values to draw from")
        return pa.table({"group": own.column(group)[:1].combine_chunks(), "n": pa.array([own.num_rows], pa.int64()), "held": pa.array([own.column("value").to_numpy().tobytes()], pa.binary())})

    held = finite.select(group, *order, F.col(value).cast("double").alias("value")).groupBy(group).applyInArrow(pack, "group string, n long, held binary")
    held = written(held.where("n > 1"))
    dealt = held.select("group", "n", F.expr(f"greatest(1L, cast(floor({draws} / n) as long))").alias("step"))
    dealt = dealt.withColumn("row", F.explode(F.expr(f"sequence(0L, {n_boot - 1}L, step)")))
    dealt = written(dealt.withColumn("rows", F.least("step", F.lit(n_boot) - F.col("row"))).drop("step"))

    def skips(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, row, rows = (part.column(c).to_pylist() for c in ("n", "row", "rows"))
            found = [passed_over(seed, a * m, b * m, m) for m, a, b in zip(n, row, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.int64())], [*part.schema.names, "over"])

    count = max(1, min(dealt.count(), 4096))
    over = dealt.repartition(count, "group", "row").mapInArrow(skips, "group string, n long, row long, rows long, over long")
    before = Window.partitionBy("group").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    started = over.withColumn("skipped", F.coalesce(F.sum("over").over(before), F.lit(0)))

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                found = medians(np.frombuffer(r["held"], np.float64), seed, r["row"], r["rows"], r["skipped"])
                yield pa.RecordBatch.from_arrays([pa.array([r["group"]] * len(found), pa.string()), pa.array(found)], ["group", "median"])

    each = started.join(held.select("group", "held"), "group").repartition(count, "group", "row").mapInArrow(draw, "group string, median double")
    ends = (F.percentile("median", F.lit(q)).alias(name) for q, name in ((alpha / 2, "ci_lo"), (1 - alpha / 2, "ci_hi")))
    return each.groupBy(F.col("group").alias(group)).agg(*ends)
