"""Quantiles by counting against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from planewise.operators import selection as L

WANTED = {"least": ("a", 0.0), "p30": ("a", 0.3), "mid": ("a", 0.5), "most": ("a", 1.0), "b99": ("b", 0.99)}


def rows(rng, n):
    """Many ties in one column, few in the other, nulls in both, and a group without values."""
    out = [(rng.choice(["x", "y", None]), float(rng.integers(5)) if rng.random() < 0.9 else None, float(rng.normal()) if rng.random() < 0.5 else None) for _ in range(n)]
    return [*out, ("empty", None, None), ("one", 3.0, None), *[("hot", 7.0, float(k)) for k in range(300)]]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_quantiles(spark, parts):
    data = rows(np.random.default_rng(parts), 400)
    table = spark.createDataFrame(data, "g string, a double, b double").repartition(5)
    want = {}
    for g in {r[0] for r in data}:
        for name, (c, q) in WANTED.items():
            values = [r[1 if c == "a" else 2] for r in data if r[0] == g]
            values = [v for v in values if v is not None]
            want[g, name] = pytest.approx(np.quantile(values, q)) if values else None
    got = L.summarised(table, [F.count("*").alias("n")], WANTED, ("g",), ("a", "b"), parts)
    assert got.columns == ["g", "n", *WANTED]
    assert {(r.g, name): r[name] for r in got.collect() for name in WANTED} == want
    assert {r.g: r.n for r in got.collect()}["empty"] == 1
    (whole,) = L.quantiles(table, WANTED, parts=parts).collect()
    assert whole.mid == np.median([r[1] for r in data if r[1] is not None])
    assert L.quantiles(table.limit(0), WANTED, ("g",), parts).collect() == []


def test_no_task_holds_a_group(spark):
    """What is gathered beside a group's values is a row for each part of it."""
    table = spark.range(20_000).select((F.col("id") % 9973).cast("double").alias("a"))
    dealt = L.ranges(table.groupBy(F.col("a").alias("value")).agg(F.count("*").alias("n")), ("value",), 8)
    sizes = {r.part: r["count"] for r in dealt.groupBy("part").count().collect()}
    assert len(sizes) == 8 and max(sizes.values()) < 9973 / 4
    ends = {r.part: (r.low, r.high) for r in dealt.groupBy("part").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()}
    assert all(ends[k][1] < ends[k + 1][0] for k in range(7))
    (got,) = L.quantiles(table, {"mid": ("a", 0.5)}, parts=8).collect()
    assert got.mid == np.median(np.arange(20_000) % 9973)
