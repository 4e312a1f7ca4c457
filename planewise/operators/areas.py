"""Plane areas, z spans and the single-slice filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewise.functions.columns import KEYS, labels_first, ratio
from planewise.functions.constants import DEEP_MIN, LAYER_SPAN_CUTOFF, THIN_MAX


def plane_areas(voxels: DataFrame, keys: tuple[str, ...] = KEYS, extra: tuple[str, ...] = ()) -> DataFrame:
    """Voxels of each label on each plane (absent: 0); background left out.  Counts are combined before the shuffle."""
    counted = voxels.where("label > 0").groupBy(*labels_first(keys), "z", *extra).agg(F.count("*").alias("area"))
    return counted.select(*keys, "label", "z", *extra, "area")


def span_table(areas: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per label: extent in z, planes present, gaps, and statistics of the present areas."""
    out = areas.where("area > 0").groupBy(*labels_first(keys)).agg(
        F.min("z").alias("z_start"), F.max("z").alias("z_end"), F.count("*").cast("int").alias("n_planes"),
        F.min("area").alias("area_min"), F.median("area").alias("area_median"), F.max("area").alias("area_max"), F.sum("area").alias("n_voxels"),
    )
    out = out.withColumn("z_span", (F.col("z_end") - F.col("z_start") + 1).cast("int"))
    out = out.withColumn("has_z_gap", F.col("n_planes") < F.col("z_span"))
    return out.select(*keys, "label", *(c for c in out.columns if c not in labels_first(keys)))


def check_z_span(areas: DataFrame, cutoff: int = LAYER_SPAN_CUTOFF, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Bounding planes of each label and whether it spans more than ``cutoff`` of them."""
    out = areas.groupBy(*keys, "label").agg(F.min("z").alias("z_start"), F.max("z").alias("z_end"))
    out = out.withColumn("z_span", (F.col("z_end") - F.col("z_start") + 1).cast("int"))
    return out.withColumn("spans_multiple_layers", F.col("z_span") > cutoff)


def thin_and_deep(spans: DataFrame, thin_max: int = THIN_MAX, deep_min: int = DEEP_MIN) -> DataFrame:
    return spans.withColumn("thin", F.col("z_span") <= thin_max).withColumn("deep", F.col("z_span") >= deep_min)


def applies(drop_in: tuple[str, ...] | None, drop: bool = True) -> Column:
    """Whether the filter applies to a row's technique; None means to all."""
    return F.lit(drop) if drop_in is None else F.lit(drop) & F.col("method").isin(*drop_in)


def single_slice(spans: DataFrame, drop: bool = True, drop_in: tuple[str, ...] | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Labels that the filter removes: those on one plane only."""
    return spans.where((F.col("z_span") == 1) & applies(drop_in, drop)).select(*keys, "label")


def drop_labels(voxels: DataFrame, labels: DataFrame, keys: tuple[str, ...] = KEYS, few: bool = False) -> DataFrame:
    """The listed labels become background; no voxel and no other id changes.

    What is background already is not joined: all of it would have one key for each segmentation, and be most of the rows.
    ``few`` labels are sent to all tasks instead, and voxels are read once; a null in its key spares background the search.
    """
    is_background = F.coalesce(F.col("label") == 0, F.lit(True))
    listed = labels.select(*labels_first(keys)).withColumn("_hit", F.lit(True))
    if few:
        searched = voxels.withColumn("_label", F.when(~is_background, F.col("label")))
        marked = searched.join(F.broadcast(listed.withColumnRenamed("label", "_label")), ["_label", *keys], "left")
    else:
        marked = voxels.where(~is_background).join(listed, labels_first(keys), "left")
    marked = marked.withColumn("label", F.when(F.col("_hit"), F.lit(0).cast("long")).otherwise(F.col("label"))).select(*voxels.columns)
    return marked if few else marked.unionByName(voxels.where(is_background))


def keep_labels(voxels: DataFrame, labels: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Only the voxels of the listed labels."""
    return voxels.join(labels.select(*keys, "label"), [*keys, "label"], "left_semi")


def filter_report(spans: DataFrame, drop: bool = True, drop_in: tuple[str, ...] | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """How many labels there are, are dropped, and are on one plane; the percentage counts those even with the filter off."""
    out = spans.groupBy(*keys).agg(F.count("*").alias("n_total"), F.count_if(F.col("z_span") == 1).alias("n_single_slice"))
    out = out.withColumn("n_dropped", F.when(applies(drop_in, drop), F.col("n_single_slice")).otherwise(F.lit(0).cast("long")))
    share = ratio(100.0 * F.col("n_single_slice"), F.col("n_total"))
    return out.withColumn("pct_dropped", share).withColumn("pct_single_slice", share)


def filter_single_slice(voxels: DataFrame, areas: DataFrame, drop: bool = True, drop_in: tuple[str, ...] | None = None, keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Kept voxels (relabelled, not removed), dropped labels, kept areas, and the report.  Areas are reused, not measured again."""
    spans = span_table(areas, keys)
    dropped = single_slice(spans, drop, drop_in, keys)
    kept = areas.join(dropped, [*keys, "label"], "left_anti")
    return drop_labels(voxels, dropped, keys), dropped, kept, filter_report(spans, drop, drop_in, keys)


def span_distribution(spans: DataFrame, group: str = "method", max_span: int = 6) -> DataFrame:
    """Percentage of each group's masks by z span; the last bin holds all longer ones, absent bins are 0."""
    binned = spans.select(group, F.least("z_span", F.lit(max_span)).alias("s"))
    shares = [ratio(100.0 * F.count_if(F.col("s") == k), F.count("*")).alias(f"span_{k}") for k in range(1, max_span + 1)]
    return binned.groupBy(group).agg(*shares)


def span_layers(voxels: DataFrame, spans: DataFrame, cutoff: int = LAYER_SPAN_CUTOFF, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Voxels of masks that span exactly ``cutoff`` planes, or one more, with the ``layer``."""
    wanted = spans.where(F.col("z_span").isin(cutoff, cutoff + 1)).select(*keys, "label", F.concat(F.lit("span_"), "z_span").alias("layer"))
    return voxels.where("label > 0").join(wanted, [*keys, "label"])
