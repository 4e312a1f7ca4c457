"""Roll-ups that are printed, plotted or described for scans of many volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewise.functions.columns import KEYS, ratio
from planewise.operators.selection import summarised
from planewise.sources.catalog import variant


def span_summary(spans: DataFrame, group: tuple[str, ...] = ("method",)) -> DataFrame:
    """Masks and quartiles of their z span."""
    quartiles = {f"p{q}_z_span": ("z_span", q / 100) for q in (25, 50, 75)}
    out = summarised(spans, [F.count("*").alias("n_masks"), F.max("z_span").alias("max_z_span")], quartiles, group, ("z_span",))
    return out.select(*group, "n_masks", "p25_z_span", "p50_z_span", "p75_z_span", "max_z_span")


def output_summary(spans: DataFrame, cutoff: int = 1, group: tuple[str, ...] = ("method",)) -> DataFrame:
    """Masks, those on one and two planes, and those on more than ``cutoff``."""
    return spans.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.col("z_span") == 1).alias("n_single"), F.count_if(F.col("z_span") == 2).alias("n_double"), F.count_if(F.col("z_span") > cutoff).alias("n_over"))


def profile_quantiles(masks: DataFrame, column: str, cutoff: float, group: tuple[str, ...] = ("method",)) -> DataFrame:
    """Upper quantiles of a profile metric and the share of measured masks above the cutoff."""
    q = {f"p{k}": (column, k / 100) for k in (50, 75, 90, 95, 99)}
    over = ratio(100.0 * F.count_if(F.col(column) > cutoff), F.count(column))
    out = summarised(masks, [F.count(column).alias("n"), F.max(column).alias("max"), over.alias("pct_over")], q, group, (column,))
    return out.select(*group, "n", *q, "max", "pct_over")


def worst(masks: DataFrame, column: str, n: int = 10, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The masks with the largest values, ties by key: a top-k, not a full sort."""
    return masks.where(F.col(column).isNotNull()).orderBy(F.desc(column), *keys, "label").limit(n)


def worst_gapped(spans: DataFrame, n: int = 10, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Gapped masks by missing planes, then by span."""
    gaps = spans.where("has_z_gap").withColumn("n_missing", F.col("z_span") - F.col("n_planes"))
    return gaps.orderBy(F.desc("n_missing"), F.desc("z_span"), *keys, "label").limit(n)


def filter_by_method(report: DataFrame) -> DataFrame:
    """Single-slice report over all fields of a technique."""
    return report.groupBy("method").agg(
        F.count("*").alias("n_fovs"), F.sum("n_total").alias("n_total"), F.sum("n_dropped").alias("n_dropped"), F.median("pct_dropped").alias("median_pct"),
        F.min("pct_dropped").alias("min_pct"), F.max("pct_dropped").alias("max_pct"), ratio(100.0 * F.sum("n_dropped"), F.sum("n_total")).alias("pct_dropped"),
    )


def log_distribution(masks: DataFrame, column: str, cutoff: float, bins: int = 45, group: tuple[str, ...] = ("method",)) -> DataFrame:
    """Share of measured masks by logarithmic bin between 1 and the largest value over all groups."""
    top = masks.agg(F.greatest(F.max(column), F.lit(1.3 * cutoff), F.lit(1.1)).alias("top"))
    at = F.least(F.floor(bins * F.log10(F.greatest(F.least(F.col(column), F.col("top")), F.lit(1.0))) / F.log10("top")), F.lit(bins - 1))
    binned = masks.where(F.col(column).isNotNull()).crossJoin(F.broadcast(top)).select(*group, at.cast("long").alias("bin"))  # one row
    counts = binned.groupBy(*group, "bin").agg(F.count("*").alias("n"))
    return counts.join(counts.groupBy(*group).agg(F.sum("n").alias("total")), list(group)).select(*group, "bin", "n", ratio(F.col("n"), F.col("total")).alias("share"))


def log_distribution_notes(masks: DataFrame, column: str, group: tuple[str, ...] = ("method",)) -> DataFrame:
    """Median of the measured masks, which the plot marks, and how many could not be measured."""
    out = summarised(masks, [F.count_if(F.col(column).isNull()).alias("n_null")], {"median": (column, 0.5)}, group, (column,))
    return out.select(*group, "median", "n_null")


def span_shares(spans: DataFrame, group: tuple[str, ...] = ("method",)) -> DataFrame:
    """Share of masks at each z span, without a cap."""
    counts = spans.groupBy(*group, "z_span").agg(F.count("*").alias("n"))
    return counts.join(counts.groupBy(*group).agg(F.sum("n").alias("total")), list(group)).select(*group, "z_span", "n", ratio(F.col("n"), F.col("total")).alias("share"))


def worst_profiles(areas: DataFrame, masks: DataFrame, column: str, n: int = 10, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Area profiles of the worst masks."""
    return areas.join(worst(masks, column, n, keys).select(*keys, "label"), [*keys, "label"], "left_semi")


def volume_summary(spans: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row for each volume: labels, share on several planes, mean and largest span, and gapped labels."""
    return spans.groupBy(*keys).agg(*_volume_sums())


def _volume_sums() -> list[Column]:
    return [
        F.count("*").alias("n_labels"), (100.0 * F.avg((F.col("z_span") > 1).cast("double"))).alias("pct_multi_layer"),
        F.avg("z_span").alias("mean_z_span"), F.max("z_span").alias("max_z_span"), F.count_if("has_z_gap").alias("n_with_z_gaps"),
    ]


def volume_levels(spans: DataFrame, levels: tuple[tuple[str, ...], ...] = (KEYS, ("region", "method"), ("method",))) -> DataFrame:
    """``volume_summary`` for every one of the ``levels``, each a tuple of columns, from one read of the spans.

    ``level`` names the columns of a row; the others are null in it.
    """
    columns = list(dict.fromkeys(c for cs in levels for c in cs))
    kept = F.concat_ws("/", *(F.when(F.grouping(c) == 0, F.lit(c)) for c in columns))
    return spans.groupingSets([list(cs) for cs in levels], *columns).agg(kept.alias("level"), *_volume_sums())


def section_areas(voxels: DataFrame, n_sections: int, column: str = "y", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Area of each label by plane and horizontal band; the bands of a plane add up to its area."""
    height = voxels.groupBy(*keys).agg((F.max(column) + 1).alias("height"))
    banded = voxels.where("label > 0").join(height, list(keys)).withColumn("section", F.floor(F.col(column) * n_sections / F.col("height")).cast("long"))
    return banded.groupBy(*keys, "label", "z", "section").agg(F.count("*").alias("area"))


def thin_rate(spans: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Masks and the percentage that occupies at most two planes, by the planes present."""
    return spans.groupBy(*keys).agg(F.count("*").alias("n_masks"), (100.0 * F.avg((F.col("n_planes") <= 2).cast("double"))).alias("thin_rate"))


def coverage(spans: DataFrame) -> DataFrame:
    """Fields measured, by region and technique."""
    return spans.groupBy("region", "method").agg(F.countDistinct("fov").alias("n_fovs"))


def centroids(rates: DataFrame) -> DataFrame:
    """Mean yield and thin rate of each technique, over its fields."""
    return rates.groupBy("method").agg(F.avg("n_masks").alias("mean_yield"), F.avg("thin_rate").alias("mean_thin_rate"))


def centroid_shift(rates: DataFrame, a: str, b: str) -> DataFrame:
    """How the mean yield and thin rate move from technique a to technique b."""
    own = centroids(rates)

    def step(c: str) -> F.Column:
        return F.max(F.when(F.col("method") == b, F.col(c))) - F.max(F.when(F.col("method") == a, F.col(c)))

    return own.agg(step("mean_yield").alias("d_yield"), step("mean_thin_rate").alias("d_thin_rate"))


def variant_summary(spans: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """``volume_summary`` for each combination of levels, as one column ``variant``."""
    return volume_summary(spans.withColumn("variant", variant(*levels)), ("variant",))


def quiet_sample(masks: DataFrame, flagged: str, n: int = 80, seed: int = 0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """At most ``n`` masks that are not flagged, picked by a seeded hash, for the background of a profile plot."""
    return masks.where(~F.col(flagged)).orderBy(F.xxhash64(F.lit(seed), *keys, "label"), *keys, "label").limit(n)
