"""Area profiles through z: jitter and sway."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planewise.functions.columns import KEYS, first_of_largest, flag, labels_first
from planewise.functions.constants import AREA_FLOOR, CUTOFF_QUANTILE, JITTER_CUTOFF, SLIVER_FRAC, SWAY_CUTOFF
from planewise.functions.storage import written
from planewise.operators.selection import quantiles


def kept_planes(areas: DataFrame, area_floor: float = AREA_FLOOR, sliver_frac: float = SLIVER_FRAC, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """All present planes with ``kept``: at least the floor, and at least a share of the label's largest plane."""
    # in the order of z, so that it is also that of the neighbours in ``profiles``, and planes are sorted once
    whole = Window.partitionBy(*labels_first(keys)).orderBy("z").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    peak = F.max("area").over(whole)
    return areas.where("area > 0").withColumn("kept", (F.col("area") >= area_floor) & (F.col("area") >= sliver_frac * peak))


def corners(planes: DataFrame, area_floor: float = AREA_FLOOR, sliver_frac: float = SLIVER_FRAC, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """All present planes with ``kept``, and ``corner`` and ``depth`` of those in the middle of a triple of adjacent kept planes.

    The neighbours come with the label's largest plane, so that one window tells which of the three are kept.
    """
    # a label has one row for each plane, so an adjacent plane, if it is present, is the row beside
    w = Window.partitionBy(*labels_first(keys)).orderBy("z")
    peak = F.max("area").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    beside = (f(c, 1).over(w).alias(f"{c}_{name}") for f, name in ((F.lag, "below"), (F.lead, "above")) for c in ("z", "area"))
    seen = planes.where("area > 0").select("*", peak.alias("peak"), *beside)

    def kept(area: str) -> F.Column:
        return (F.col(area) >= area_floor) & (F.col(area) >= sliver_frac * F.col("peak"))

    seen = seen.withColumn("kept", kept("area")).withColumn("la", F.when(F.col("kept"), F.log10(F.col("area").cast("double"))))

    def log_of(name: str, step: int) -> F.Column:
        near = F.col("kept") & kept(f"area_{name}") & (F.col(f"z_{name}") == F.col("z") + step)
        return F.when(near, F.log10(F.col(f"area_{name}").cast("double")))

    steps = seen.withColumns({"below": log_of("below", -1), "above": log_of("above", 1)})
    d0, d1 = F.col("la") - F.col("below"), F.col("above") - F.col("la")
    corner = F.abs(F.col("above") - 2.0 * F.col("la") + F.col("below"))
    depth = F.when(F.signum(d0) * F.signum(d1) < 0, F.least(F.abs(d0), F.abs(d1)))
    return steps.select(*planes.columns, "kept", corner.alias("corner"), depth.alias("depth"))


def _measures() -> dict[str, F.Column]:
    """Aggregates of a label's ``corners``."""
    measured = F.count("corner") > 0
    return {
        "n_reversals": F.count("depth"),
        "jitter": F.when(measured, F.pow(F.lit(10.0), F.coalesce(F.sum("depth"), F.lit(0.0)))),
        "sway": F.when(measured, F.pow(F.lit(10.0), F.max("corner"))),
    }


def measured_labels(planes: DataFrame, area_floor: float = AREA_FLOOR, sliver_frac: float = SLIVER_FRAC, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """What is counted of a label: extent, gaps, reversals, jitter and sway.

    One shuffle and one sort of the planes yield spans and profiles at once; medians and places of planes, which need
    more, are those of ``span_table`` and ``profiles``.
    """
    out = corners(planes, area_floor, sliver_frac, keys).groupBy(*labels_first(keys)).agg(
        F.min("z").alias("z_start"), F.max("z").alias("z_end"), F.count("*").cast("int").alias("n_planes"),
        *(c.alias(n) for n, c in _measures().items()),
    )
    out = out.withColumn("z_span", (F.col("z_end") - F.col("z_start") + 1).cast("int"))
    out = out.withColumn("has_z_gap", F.col("n_planes") < F.col("z_span"))
    return out.select(*keys, "label", "z_start", "z_span", "has_z_gap", "n_reversals", "jitter", "sway")


def profiles(areas: DataFrame, area_floor: float = AREA_FLOOR, sliver_frac: float = SLIVER_FRAC, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per label with jitter and sway, from one pass over its planes.

    Only triples of adjacent kept planes count.  Sway is the sharpest corner of the log profile; jitter sums the
    shallower limb of every reversal; both are null where there is no triple, and places are then -1.
    """
    steps = corners(areas, area_floor, sliver_frac, keys)
    own, measured = _measures(), F.count("corner") > 0
    out = steps.groupBy(*labels_first(keys)).agg(
        F.count("*").cast("int").alias("n_planes"),
        F.count_if("kept").cast("int").alias("n_planes_used"),
        F.min("area").alias("area_min"),
        F.max("area").alias("area_max"),
        own["n_reversals"].alias("n_reversals"),
        own["jitter"].alias("jitter"),
        F.when(F.count("depth") > 0, first_of_largest(F.coalesce("depth", F.lit(-1.0)), F.col("z"))).otherwise(-1).cast("int").alias("z_at_jitter"),
        own["sway"].alias("sway"),
        F.when(measured, first_of_largest(F.coalesce("corner", F.lit(-1.0)), F.col("z"))).otherwise(-1).cast("int").alias("z_at_sway"),
    )
    return out.select(*keys, "label", *(c for c in out.columns if c not in labels_first(keys)))


def flag_metric(table: DataFrame, column: str, cutoff: float | None, quantile: float = CUTOFF_QUANTILE) -> DataFrame:
    """``large_<column>``: strictly above the cutoff, or above the exact quantile of the measured values if it is None.

    Without measured values nothing is flagged.  ``cutoff_<column>`` holds the value used.
    """
    if cutoff is not None:
        return table.withColumn(f"cutoff_{column}", F.lit(float(cutoff))).withColumn(f"large_{column}", flag(F.col(column), F.lit(float(cutoff))))
    table = written(table)
    limit = quantiles(table, {f"cutoff_{column}": (column, quantile)})
    return table.crossJoin(F.broadcast(limit)).withColumn(f"large_{column}", flag(F.col(column), F.col(f"cutoff_{column}")))  # one row


def flag_jitter(table: DataFrame, cutoff: float | None = JITTER_CUTOFF) -> DataFrame:
    return flag_metric(table, "jitter", cutoff)


def flag_sway(table: DataFrame, cutoff: float | None = None) -> DataFrame:
    return flag_metric(table, "sway", cutoff)


def analyse_masks(areas: DataFrame, column: str = "sway", cutoff: float | None = None, keys: tuple[str, ...] = KEYS, **planes: float) -> DataFrame:
    """Profiles with one metric flagged."""
    return flag_metric(profiles(areas, keys=keys, **planes), column, cutoff)


def mask_table(spans: DataFrame, profile: DataFrame, jitter_cutoff: float = JITTER_CUTOFF, sway_cutoff: float = SWAY_CUTOFF, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Spans with both profile metrics and their flags."""
    own = profile.select(*keys, "label", "n_planes_used", "n_reversals", "jitter", "z_at_jitter", "sway", "z_at_sway")
    out = spans.join(own, labels_first(keys), "left")
    out = out.select(*spans.columns, *(c for c in own.columns if c not in labels_first(keys)))
    return flagged(out, jitter_cutoff, sway_cutoff)


def flagged(table: DataFrame, jitter_cutoff: float = JITTER_CUTOFF, sway_cutoff: float = SWAY_CUTOFF) -> DataFrame:
    """``large_jitter`` and ``large_sway`` by fixed cutoffs."""
    return table.withColumn("large_jitter", flag(F.col("jitter"), jitter_cutoff)).withColumn("large_sway", flag(F.col("sway"), sway_cutoff))
