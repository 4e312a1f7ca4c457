"""Paired, rank-based comparison of techniques."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.functions.constants import POLARITY
from planewise.functions.storage import written
from planewise.operators import ranks as R

PAIR = ("region", "fov")


def paired(table: DataFrame, a: str, b: str, columns: tuple[str, ...], keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Long table of ``metric``, ``x`` (technique a), ``y`` (technique b) and ``diff`` = y - x; unpaired fields go."""
    long = table.where(F.col("method").isin(a, b)).select(*keys, "method", F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns))).alias("m"))
    wide = long.groupBy(*keys, "m.metric").agg(F.max(F.when(F.col("method") == a, F.col("m.v"))).alias("x"), F.max(F.when(F.col("method") == b, F.col("m.v"))).alias("y"))
    return wide.where("x is not null and y is not null").withColumn("diff", F.col("y") - F.col("x"))


def hodges_lehmann(pairs: DataFrame) -> DataFrame:
    """Median of the means of all pairs of differences, each with itself too, of every metric."""
    return R.hodges_lehmann(pairs)


def rank_biserial(pairs: DataFrame) -> DataFrame:
    """(W+ - W-) / (W+ + W-) with tied ranks averaged and zeros left out."""
    return R.rank_biserial(R.signed_ranks(pairs))


def paired_medians(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("metric").agg(F.count("*").cast("int").alias("n_pairs"), F.median("x").alias("median_a"), F.median("y").alias("median_b"), F.median("diff").alias("median_diff"))


def signed_rank_p(n: int, n_sizes: int, up: float, ties: float, n_zero: int, exact_up_to: int = 50) -> float | None:
    """Two-sided Wilcoxon p-value of ``n`` differences that are not zero, from their signed ranks; exact without ties while small, else the normal one."""
    if not n:
        return None
    if n <= exact_up_to and n_sizes == n and not n_zero:
        ways = np.ones(1)
        for r in range(1, n + 1):  # how many sets of ranks have each sum
            grown = np.zeros(len(ways) + r)
            grown[: len(ways)] += ways
            grown[r:] += ways
            ways = grown
        low = min(up, n * (n + 1) / 2 - up)
        return float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return math.erfc(abs(up - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread else None


def signed_rank_test(pairs: DataFrame) -> DataFrame:
    """``rank_biserial`` and ``p_wilcoxon`` of every metric that has a difference other than zero."""
    ranks = R.signed_ranks(pairs).join(pairs.groupBy("metric").agg(F.count_if(F.col("diff") == 0).alias("n_zero")), "metric")

    def p_values(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:  # a row for each metric
            found = [signed_rank_p(*r) for r in part[["n", "n_sizes", "up", "ties", "n_zero"]].itertuples(index=False)]
            yield pd.DataFrame({"metric": part["metric"], "rank_biserial": part["rank_biserial"], "p_wilcoxon": pd.array(found, "Float64")})

    ranks = ranks.join(R.rank_biserial(ranks), "metric")
    return ranks.mapInPandas(p_values, "metric string, rank_biserial double, p_wilcoxon double")


def compare_exactly(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Everything about the paired differences of each metric that is not drawn, and which technique is better by its polarity."""
    out = paired_medians(pairs).join(hodges_lehmann(pairs), "metric", "left").join(signed_rank_test(pairs), "metric", "left")
    polarity = F.element_at(F.create_map(*(F.lit(x) for kv in POLARITY.items() for x in kv)), F.col("metric"))
    sign = F.signum(F.col("median_diff")) * F.coalesce(polarity, F.lit(0))
    return out.withColumn("better", F.when(sign > 0, b).when(sign < 0, a).otherwise(""))


def compare_techniques(table: DataFrame, a: str, b: str, columns: tuple[str, ...], n_boot: int = 10000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """``compare_exactly`` with the bootstrap interval of the median difference; differences are drawn from in the order of their fields."""
    pairs = written(paired(table, a, b, columns))
    drawn = R.bootstrap_intervals(pairs, "metric", PAIR, "diff", n_boot, alpha, seed)
    return compare_exactly(pairs, a, b).join(drawn, "metric", "left")


def technique_summary(scores: DataFrame, columns: tuple[str, ...] = ("Span", "Jitter", "Sway", "Signal", "Total"), n_boot: int = 10000, seed: int = 0, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Fields, and median of every score with its interval as text, for each technique."""

    value = F.explode(F.array(*(F.struct(F.lit(c).alias("score"), F.col(c).cast("double").alias("value")) for c in columns)))
    long = written(scores.select(*keys, "method", value.alias("s")).select(*keys, "method", "s.score", "s.value"))
    # a line of a technique is what draws are made for
    named = long.withColumn("line", F.concat_ws("\n", "score", "method"))
    drawn = R.bootstrap_intervals(named, "line", keys, "value", n_boot, 0.05, seed)
    lines = named.groupBy("method", "score", "line").agg(F.count("*").alias("n_fovs"), F.median(F.when(~F.isnan("value"), F.col("value"))).alias("median")).join(drawn, "line", "left")
    shown = F.when(F.col("ci_lo").isNull(), F.lit("–")).otherwise(F.format_string("[%.2f, %.2f]", "ci_lo", "ci_hi"))
    both = (f for c in columns for f in (F.max(F.when(F.col("score") == c, F.col("median"))).alias(c), F.max(F.when(F.col("score") == c, shown)).alias(f"{c}_ci")))
    return lines.groupBy("method").agg(F.max("n_fovs").alias("n_fovs"), *both)
