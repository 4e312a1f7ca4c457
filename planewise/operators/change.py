"""Area change from plane to plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planewise.functions.columns import KEYS, ratio
from planewise.functions.constants import CHANGE_CUTOFF
from planewise.operators.areas import keep_labels
from planewise.operators.selection import summarised


def area_change(areas: DataFrame, metric: str = "abs_frac_change", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row for each label and pair of adjacent planes that both have it."""
    w = Window.partitionBy(*keys, "label").orderBy("z")
    steps = areas.where("area > 0").select(*keys, "label", F.col("z").alias("z_from"), F.lead("z").over(w).alias("z_to"), F.col("area").alias("area_from"), F.lead("area").over(w).alias("area_to"))
    steps = steps.where("z_to = z_from + 1").withColumn("delta_area", F.col("area_to") - F.col("area_from"))
    steps = steps.withColumn("frac_change", F.col("delta_area") / F.col("area_from")).withColumn("abs_frac_change", F.abs("frac_change"))
    steps = steps.withColumn("sym_frac_change", F.abs("delta_area") / F.least("area_from", "area_to")).withColumn("change_floor", 0.5 / F.col("area_from"))
    return steps.withColumn("log_change", F.log10(F.greatest(F.col(metric), F.col("change_floor"))))


def layer_change(changes: DataFrame, cutoff: float = CHANGE_CUTOFF, metric: str = "abs_frac_change", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Statistics of each transition over all its objects."""
    out = changes.groupBy(*keys, "z_from", "z_to").agg(
        F.avg(metric).alias("mean_change"), F.stddev_samp(metric).alias("std_change"), F.median(metric).alias("median_change"),
        F.avg("log_change").alias("mean_log_change"), F.count("*").alias("n_objects"), F.count_if(F.col(metric) > cutoff).alias("n_flagged"),
    )
    return out.withColumn("geo_mean_change", F.pow(F.lit(10.0), "mean_log_change")).withColumn("frac_flagged", ratio(F.col("n_flagged"), F.col("n_objects")))


def object_outliers(changes: DataFrame, cutoff: float = CHANGE_CUTOFF, statistic: str = "max", metric: str = "abs_frac_change", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Each object's changes, flagged if their largest, or geometric mean, is strictly past the cutoff."""
    if statistic not in ("max", "mean"):
        raise ValueError(f"statistic must be 'max' or 'mean', not {statistic!r}")
    out = changes.groupBy(*keys, "label").agg(
        F.count("*").alias("n_transitions"), F.avg(metric).alias("mean_abs_change"), F.max(metric).alias("max_abs_change"),
        F.avg("log_change").alias("mean_log_change"), F.max("log_change").alias("max_log_change"),
    )
    out = out.withColumn("log_change", F.col(f"{statistic}_log_change")).withColumn("change_stat", F.pow(F.lit(10.0), "log_change"))
    return out.withColumn("large_area_change", F.col("log_change") > F.log10(F.lit(cutoff)))


def change_layer(voxels: DataFrame, objects: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Voxels of the objects that ``object_outliers`` flags."""
    return keep_labels(voxels, objects.where("large_area_change"), keys)


def relative_outliers(changes: DataFrame, cutoff: float, scope: str = "layer", statistic: str = "max", metric: str = "abs_frac_change", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Each object's change relative to the mean of its layer, or of all changes, and whether it exceeds the cutoff."""
    by = [*keys, "z_from"] if scope == "layer" else [*keys]
    base = changes.groupBy(*by).agg(F.avg(metric).alias("base"))
    own = changes.join(base, by).withColumn("r", ratio(F.col(metric), F.col("base")))
    stat = {"max": F.max("r"), "mean": F.avg("r")}[statistic]
    return own.groupBy(*keys, "label").agg(stat.alias("ratio")).withColumn("outlier", F.coalesce(F.col("ratio") > cutoff, F.lit(False)))


def size_change(areas: DataFrame, adjacent_only: bool = True, groups: tuple[str, ...] = (*KEYS, "label")) -> DataFrame:
    """Change between consecutive observations of a group; a step over missing planes only if asked for."""
    w = Window.partitionBy(*groups).orderBy("z")
    out = areas.withColumn("z_gap", F.col("z") - F.lag("z").over(w)).withColumn("previous", F.lag("area").over(w)).where("z_gap is not null")
    out = out.withColumn("delta", F.col("area") - F.col("previous")).withColumn("pct_change", ratio(100.0 * F.col("delta"), F.col("previous")))
    return out.where("z_gap = 1") if adjacent_only else out


def change_summary(changes: DataFrame, cutoff: float = CHANGE_CUTOFF, metric: str = "abs_frac_change", keys: tuple[str, ...] = ("method",)) -> DataFrame:
    """What is printed of all transitions."""
    sums = [
        F.count("*").alias("n"), F.avg(metric).alias("mean_change"), F.pow(F.lit(10.0), F.avg("log_change")).alias("geo_mean_change"),
        F.count_if(F.col(metric) > cutoff).alias("n_over"), F.count_if(F.col(metric) == 0).alias("n_zero"), F.count_if(F.col("sym_frac_change") > cutoff).alias("n_over_sym"),
    ]
    return summarised(changes, sums, {"median_change": (metric, 0.5)}, keys, (metric, "log_change", "sym_frac_change"))


def _spread(metric: str) -> list[Column]:
    return [F.count("*").alias("n_objects"), F.avg(metric).alias("mean_change"), F.try_divide(F.stddev_samp(metric), F.sqrt(F.count("*"))).alias("sem_change")]


def layer_spread(changes: DataFrame, metric: str = "abs_frac_change", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Mean, quartiles and standard error of each transition of a field: the bands that the change plots draw."""
    quartiles = (F.percentile(metric, F.lit(q / 100)).alias(f"p{q}_change") for q in (25, 75))
    return changes.groupBy(*keys, "z_from", "z_to").agg(*_spread(metric), *quartiles)


def compare_layer_change(changes: DataFrame, metric: str = "abs_frac_change") -> DataFrame:
    """The same for each technique over all its fields."""
    quartiles = {f"p{q}_change": (metric, q / 100) for q in (25, 75)}
    return summarised(changes, _spread(metric), quartiles, ("method", "z_from", "z_to"), (metric,))


def log_axis(changes: DataFrame, cutoff: float | None = CHANGE_CUTOFF, decades: int = 4, metric: str = "abs_frac_change", xmin: float | None = None, xmax: float | None = None) -> DataFrame:
    """Lower and upper end of a logarithmic axis.

    Up to the largest change, with the cutoff in view (1 if nothing changes), or to ``xmax``; down to the decade of the
    least positive change, but ``decades`` at most, or to ``xmin``; one decade at least, and one below the cutoff.
    """
    most, least = F.max(metric), F.min(F.when(F.col(metric) > 0, F.col(metric)))
    ends = changes.agg((most if xmax is None else F.lit(float(xmax))).alias("most"), least.alias("least"))
    top = F.when(F.col("most") > 0, F.col("most")).otherwise(1.0)
    if cutoff is not None and xmax is None:
        top = F.greatest(top, F.lit(1.2 * cutoff))
    ends = ends.select("least", top.alias("top"))
    floor = F.col("top") / 10.0**decades
    low = F.coalesce(F.greatest(F.pow(F.lit(10.0), F.floor(F.log10("least"))), floor), floor) if xmin is None else F.lit(float(xmin))
    low = F.least(low, F.col("top") / 10)
    return ends.select((low if cutoff is None else F.least(low, F.lit(cutoff / 10))).alias("lo"), F.col("top").alias("hi"))


def change_histogram(changes: DataFrame, cutoff: float = CHANGE_CUTOFF, bins: int = 60, metric: str = "abs_frac_change", keys: tuple[str, ...] = ("method",)) -> DataFrame:
    """Changes by logarithmic bin on the axis that ``log_axis`` gives; those below it count in the first bin, those of zero too."""
    axis = log_axis(changes, cutoff, metric=metric)
    at = F.floor(bins * F.log10(F.greatest(F.col(metric), F.col("lo")) / F.col("lo")) / F.log10(F.col("hi") / F.col("lo")))
    binned = changes.crossJoin(F.broadcast(axis)).select(*keys, F.least(at, F.lit(bins - 1)).cast("long").alias("bin"))  # one row
    return binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
