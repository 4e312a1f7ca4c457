"""Exact quantiles of groups of any size, by counting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planewise.functions.storage import written


def ranges(counts: DataFrame, order: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """``counts`` dealt by ranges of ``order`` and written, with ``part``: a row of a smaller part sorts before one of a larger."""
    spark = counts.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return written(counts.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))


def part_starts(dealt: DataFrame, by: tuple[str, ...], sums: Mapping[str, Column]) -> DataFrame:
    """For each group and part, ``n`` rows of counts ``n``, ``before`` it, and ``total``; each of ``sums`` also with ``<name>_before``.

    There are as many rows as parts of a group, so its window is small however large the group.
    """
    own = dealt.groupBy(*by, "part").agg(F.sum("n").alias("n"), *(c.alias(s) for s, c in sums.items()))
    upto = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    for c in ("n", *sums):
        own = own.withColumn("before" if c == "n" else f"{c}_before", F.coalesce(F.sum(c).over(upto), F.lit(0)))
    return own.withColumn("total", F.sum("n").over(Window.partitionBy(*by)))


def same(a: DataFrame, b: DataFrame, on: tuple[str, ...], how: str = "left") -> DataFrame:
    """Join on equal columns, where null equals null, keeping those of ``a``."""
    other = b.select(*(F.col(c).alias(f"_{c}") for c in on), *(c for c in b.columns if c not in on))
    condition = F.lit(True)
    for c in on:
        condition &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(other, condition, how).drop(*(f"_{c}" for c in on))


def quantiles(table: DataFrame, wanted: Mapping[str, tuple[str, float]], by: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """One row for each group that has a value: the exact quantiles ``wanted``, name by column and share, linear between ranks.

    Equal values are counted where they are, and the counts are dealt by ranges of their values.  Sums of the parts tell which of
    them holds a rank; only there running sums are formed, so no task holds a group's values.  Nulls are left out.
    """
    columns = dict.fromkeys(c for c, _ in wanted.values())
    value = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns)))
    each = table.select(*by, value.alias("v")).select(*by, "v.column", "v.value").where("value is not null")
    keys = (*by, "column")
    dealt = ranges(each.groupBy(*keys, "value").agg(F.count("*").alias("n")), (*keys, "value"), parts)
    starts = part_starts(dealt, keys, {})
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).alias("of"), F.lit(float(q)).alias("q")) for n, (c, q) in wanted.items())))
    places = starts.withColumn("a", asked).where(F.col("a.of") == F.col("column")).withColumn("at", (F.col("total") - 1) * F.col("a.q"))
    ends = F.explode(F.array(F.struct(F.floor("at").alias("rank"), F.lit("low").alias("end")), F.struct(F.ceil("at").alias("rank"), F.lit("high").alias("end"))))
    places = places.withColumn("r", ends).where("r.rank >= before and r.rank < before + n")
    places = places.select(*keys, "part", "a.name", "r.rank", "r.end", "before", (F.col("at") - F.floor("at")).alias("share"))
    inside = same(dealt, places.select(*keys, "part").distinct(), (*keys, "part"), "left_semi")
    running = F.sum("n").over(Window.partitionBy(*keys, "part").orderBy("value"))
    found = same(inside.withColumn("upto", running), places, (*keys, "part"), "inner")
    found = found.where("rank < before + upto and rank >= before + upto - n")
    def at(name: str, end: str) -> Column:
        return F.max(F.when((F.col("name") == name) & (F.col("end") == end), F.col("value")))

    def share(name: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col("share")))

    return found.groupBy(*by).agg(*(((1 - share(n)) * at(n, "low") + share(n) * at(n, "high")).alias(n) for n in wanted))


def summarised(table: DataFrame, aggregates: Sequence[Column], wanted: Mapping[str, tuple[str, float]], by: tuple[str, ...], columns: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """Ordinary ``aggregates`` of each group and the exact quantiles ``wanted``, null where a group has no value.

    The ``columns`` that both need are written once, so that what ``table`` is derived from is read once.
    """
    kept = written(table.select(*dict.fromkeys((*by, *columns))))
    return same(kept.groupBy(*by).agg(*aggregates), quantiles(kept, wanted, by, parts), by)
