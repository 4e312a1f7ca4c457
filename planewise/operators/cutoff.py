"""Brightness distributions either side of a cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewise.functions.columns import KEYS, labels_first, ratio
from planewise.functions.constants import BRIGHTNESS_CUTOFF, OVERLAP_QUANTILE
from planewise.operators.brightness import auc, left_edge, overlap_layer, overlap_thresholds, vectorise_pixels


def exact_bins() -> Column:
    """Bins of one value each: width 1 and edges on the halves."""
    return (F.abs(F.col("width") - 1.0) < 1e-8) & (F.abs(F.pmod(F.col("lo"), F.lit(1.0)) - 0.5) < 1e-8)


def cut_point(cutoff: float = BRIGHTNESS_CUTOFF) -> Column:
    """Half below a whole cutoff on exact bins, so that below means strictly below."""
    return F.when(exact_bins(), F.lit(cutoff - 0.5)).otherwise(F.lit(float(cutoff))) if float(cutoff).is_integer() else F.lit(float(cutoff))


def below_weight(cutoff: float = BRIGHTNESS_CUTOFF) -> Column:
    """The share of a bin that lies below the cutoff."""
    return F.least(F.greatest((cut_point(cutoff) - left_edge()) / F.col("width"), F.lit(0.0)), F.lit(1.0))


def split_counts(hist: DataFrame, cutoff: float = BRIGHTNESS_CUTOFF) -> DataFrame:
    """``below`` and ``above`` parts of every bin's count."""
    return hist.withColumn("below", F.col("n") * below_weight(cutoff)).withColumn("above", F.col("n") - F.col("below"))


def cutoff_within(hist: DataFrame, cutoff: float = BRIGHTNESS_CUTOFF, keys: tuple[str, ...] = ("region", "fov")) -> DataFrame:
    """Area of each technique's masked and unmasked curve on either side."""
    out = split_counts(hist, cutoff).groupBy(*keys, "method", "masked").agg(F.sum("below").alias("b"), F.sum("above").alias("a"))
    total = F.col("a") + F.col("b")
    out = out.withColumn("auc_below", ratio(F.col("b"), total)).withColumn("auc_above", ratio(F.col("a"), total))
    return out.select(*keys, "method", F.when(F.col("masked"), "masked").otherwise("unmasked").alias("group"), (100.0 * F.col("auc_below")).alias("pct_below"), (100.0 * F.col("auc_above")).alias("pct_above"), "auc_below", "auc_above")


def cutoff_across(hist: DataFrame, cutoff: float = BRIGHTNESS_CUTOFF, keys: tuple[str, ...] = ("region", "fov")) -> DataFrame:
    """Every pair of techniques, by name: shares above, their difference a - b, and the rank AUC on each side."""
    parts = split_counts(hist, cutoff).groupBy(*keys, "masked", "method", "bin").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
    methods = parts.select(*keys, "masked", "method").distinct()
    pairs = methods.withColumnRenamed("method", "method_a").join(methods.withColumnRenamed("method", "method_b"), [*keys, "masked"]).where("method_a < method_b")
    on = [*keys, "masked"]
    by = (*on, "method_a", "method_b")
    # a bin's counts of either technique of a pair, whether or not the other has the bin
    sides = pairs.join(parts, on).where("method = method_a or method = method_b")
    is_a = F.col("method") == F.col("method_a")

    def only(own: Column, column: str) -> Column:
        return F.sum(F.when(own, F.col(column)).otherwise(0.0))

    wide = sides.groupBy(*by, "bin").agg(only(is_a, "below").alias("ba"), only(is_a, "above").alias("aa"), only(~is_a, "below").alias("bb"), only(~is_a, "above").alias("ab"))
    totals = wide.groupBy(*by).agg(ratio(100.0 * F.sum("aa"), F.sum("aa") + F.sum("ba")).alias("pct_above_a"), ratio(100.0 * F.sum("ab"), F.sum("ab") + F.sum("bb")).alias("pct_above_b"))
    low = auc(wide.select(*by, "bin", F.col("ba").alias("a"), F.col("bb").alias("b")), by, "auc_below")
    high = auc(wide.select(*by, "bin", F.col("aa").alias("a"), F.col("ab").alias("b")), by, "auc_above")
    out = totals.withColumn("d_pct_above", F.col("pct_above_a") - F.col("pct_above_b")).join(low, list(by)).join(high, list(by))
    return out.withColumn("group", F.when(F.col("masked"), "masked").otherwise("unmasked")).drop("masked")


def cutoff_report(hist: DataFrame, cutoff: float = BRIGHTNESS_CUTOFF) -> tuple[DataFrame, DataFrame]:
    return cutoff_within(hist, cutoff), cutoff_across(hist, cutoff)


def cutoff_layers(voxels: DataFrame, cutoff: float = BRIGHTNESS_CUTOFF) -> DataFrame:
    """Masked voxels below the cutoff, and unmasked ones at or above it."""
    layer = F.when(F.col("masked") & (F.col("brightness") < cutoff), "masked_below").when(~F.col("masked") & (F.col("brightness") >= cutoff), "unmasked_above")
    return vectorise_pixels(voxels).withColumn("layer", layer).where("layer is not null").select(*voxels.columns, "layer")


def _flags() -> Column:
    """Names of the flag layers that a mask belongs to."""
    names = {"thin": "thin", "deep": "deep", "z_gap": "has_z_gap", "jitter": "large_jitter", "sway": "large_sway"}
    return F.filter(F.array(*(F.when(F.col(c), F.lit(n)) for n, c in names.items())), lambda x: x.isNotNull())


def flag_layers(voxels: DataFrame, masks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Voxels of flagged masks, once for each of the ``layer`` names thin, deep, z_gap, jitter and sway that the mask has."""
    flagged = masks.select(*labels_first(keys), _flags().alias("layers")).where(F.size("layers") > 0)
    return voxels.where("label > 0").join(flagged, labels_first(keys)).select(*voxels.columns, F.explode("layers").alias("layer"))


def defect_layers(voxels: DataFrame, masks: DataFrame, dropped: DataFrame, hist: DataFrame, quantile: float = OVERLAP_QUANTILE, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """All layers of a card over the voxels before the filter: the flags, ``dropped``, and the two by brightness.

    ``masks`` are those the filter kept and ``hist`` was counted after it, so to the brightness layers a dropped label is
    background.  An image without voxels of either kind has no brightness layers.  Only voxels of labels are joined with
    marks: the background has one key for each segmentation, and no marks.
    """
    marks = masks.select(*keys, "label", _flags().alias("marks"), F.lit(False).alias("_dropped")).where(F.size("marks") > 0)
    marks = marks.unionByName(dropped.select(*keys, "label", F.array(F.lit("dropped")).alias("marks"), F.lit(True).alias("_dropped")))
    none = F.array().cast("array<string>")
    labelled = F.coalesce(F.col("label") > 0, F.lit(False))
    marked = voxels.where(labelled).join(marks, labels_first(keys), "left")
    marked = marked.select(*voxels.columns, F.coalesce("marks", none).alias("marks"), (~F.coalesce("_dropped", F.lit(False))).alias("masked"))
    plain = voxels.where(~labelled).select(*voxels.columns, none.alias("marks"), (F.col("label") > 0).alias("masked"))
    thresholds = overlap_thresholds(hist, quantile, keys)
    v = marked.unionByName(plain).join(thresholds, list(keys), "left").withColumn("_bright", overlap_layer())
    layers = F.when(F.col("_bright").isNull(), F.col("marks")).otherwise(F.concat("marks", F.array("_bright")))
    return v.select(*voxels.columns, F.explode(layers).alias("layer"))
