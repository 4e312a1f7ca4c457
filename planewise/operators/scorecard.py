"""Metrics of each segmentation and the weighted scorecard."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property, reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.functions.columns import IMAGE, KEYS, number_of, ratio
from planewise.functions.constants import AREA_FLOOR, JITTER_CUTOFF, SCORE_WEIGHTS, SLIVER_FRAC, SWAY_CUTOFF
from planewise.functions.storage import written
from planewise.operators import areas as A
from planewise.operators import brightness as B
from planewise.operators import profile as P


#: Dropped labels that are sent to all tasks: about what Spark sends of a file of 10 MB.
FEW_DROPPED = 1_500_000
#: The number that stands for the keys of a segmentation while its voxels and planes are counted.
SEG = "_seg"


class Scan:
    """What a scan yields, for all fields and techniques at once; each table is derived on first use and then kept.

    Voxels are read three times: for the segmentations, with the range of brightness, for the labels, and for the histograms,
    whose bins depend on each image's range and whose masked voxels depend on the filter.  The segmentations come first, so that
    one number, known to be no other's, stands for the keys of each in all that is shuffled, sorted and counted.  All three
    tables are small beside the voxels and written once; metrics, filter and statistics are derived from them.  The table of
    planes is for what lists masks, and written when asked for.
    """

    def __init__(self, voxels: DataFrame, area_floor: float = AREA_FLOOR, sliver_frac: float = SLIVER_FRAC, drop: bool = True, drop_in: tuple[str, ...] | None = None, keys: tuple[str, ...] = KEYS) -> None:
        self.voxels, self.area_floor, self.sliver_frac, self.drop, self.drop_in, self.keys = voxels, area_floor, sliver_frac, drop, drop_in, keys

    @cached_property
    def segmentations(self) -> DataFrame:
        """The range of brightness of each segmentation, background included."""
        return written(self.voxels.groupBy(*self.keys).agg(*B.ends()))

    @cached_property
    def salt(self) -> int:
        """The first salt that gives every segmentation a number of its own."""
        salt = 0
        while True:
            numbers = self.segmentations.select(number_of(self.keys, salt).alias(SEG))
            found = numbers.agg(F.count("*").alias("all"), F.count_distinct(SEG).alias("own")).first()
            if found["all"] == found["own"]:
                return salt
            salt += 1

    @property
    def named(self) -> DataFrame:
        """The keys of each number."""
        return self.segmentations.select(*self.keys, number_of(self.keys, self.salt).alias(SEG))

    def numbered(self) -> DataFrame:
        """The voxels by number of their segmentation, without its keys."""
        return self.voxels.select(number_of(self.keys, self.salt).alias(SEG), "z", "label", "brightness")

    @cached_property
    def planes(self) -> DataFrame:
        return written(A.plane_areas(self.voxels, self.keys))

    @cached_property
    def labels(self) -> DataFrame:
        """Extent, profile and gaps of each label, before the filter, from one pass over its planes."""
        measured = P.measured_labels(A.plane_areas(self.numbered(), (SEG,)), self.area_floor, self.sliver_frac, (SEG,))
        return written(measured.join(self.named, SEG).select(*self.keys, *(c for c in measured.columns if c != SEG)))

    @cached_property
    def areas(self) -> DataFrame:
        """All plane areas, before the filter."""
        return self.planes.where("label > 0").select(*self.keys, "label", "z", "area")

    @cached_property
    def spans(self) -> DataFrame:
        return A.span_table(self.areas, self.keys)

    @cached_property
    def dropped(self) -> DataFrame:
        """Labels that the filter makes background, written once: where they are few, joins with voxels broadcast the file."""
        return written(A.single_slice(self.labels, self.drop, self.drop_in, self.keys))

    @cached_property
    def filters(self) -> DataFrame:
        return A.filter_report(self.labels, self.drop, self.drop_in, self.keys)

    def kept(self, spans: DataFrame) -> DataFrame:
        """Labels that the filter leaves."""
        return spans.where((F.col("z_span") > 1) | ~F.coalesce(A.applies(self.drop_in, self.drop), F.lit(False)))

    @cached_property
    def measures(self) -> DataFrame:
        """The kept masks with what metrics, cards and layers need of ``masks``, without another pass over the planes."""
        return P.flagged(A.thin_and_deep(self.kept(self.labels)), JITTER_CUTOFF, SWAY_CUTOFF)

    @cached_property
    def masks(self) -> DataFrame:
        """A row for each kept mask, measured and flagged.  The filter takes whole labels, so what is kept measures as before it."""
        return P.mask_table(A.thin_and_deep(self.kept(self.spans)), P.profiles(self.areas, self.area_floor, self.sliver_frac, self.keys), JITTER_CUTOFF, SWAY_CUTOFF, self.keys)

    @property
    def edges(self) -> DataFrame:
        """The bins of each image."""
        return B.edges_of(self.segmentations.groupBy(*IMAGE).agg(*B.ends("low", "high", "whole")))

    @cached_property
    def hist(self) -> DataFrame:
        """Brightness by plane; removed voxels have joined the unmasked ones."""
        few = self.dropped.count() <= FEW_DROPPED
        gone = self.dropped.join(self.named, list(self.keys)).select(SEG, "label")
        edges = self.named.join(self.edges, list(IMAGE)).select(SEG, "lo", "width", "n_bins", "exact")
        found = B.histograms(A.drop_labels(self.numbered(), gone, (SEG,), few), edges, (SEG,), (SEG,))
        return written(found.join(self.named, SEG).select(*self.keys, *(c for c in found.columns if c != SEG)))

    @cached_property
    def brightness(self) -> DataFrame:
        return B.brightness_stats(self.hist, self.keys)


def scan(voxels: DataFrame, area_floor: float = AREA_FLOOR, sliver_frac: float = SLIVER_FRAC, drop: bool = True, drop_in: tuple[str, ...] | None = None, keys: tuple[str, ...] = KEYS) -> Scan:
    """Filter, measure and flag every mask."""
    return Scan(voxels, area_floor, sliver_frac, drop, drop_in, keys)


def fov_metrics(masks: DataFrame, brightness: DataFrame | None = None, filters: DataFrame | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row for each segmentation; shares of jittery and swayed masks are of those that can be measured."""

    def percent(c: str) -> F.Column:
        return (100.0 * F.avg(F.col(c).cast("double"))).alias("pct_z_gap" if c == "has_z_gap" else f"pct_{c}")

    out = masks.groupBy(*keys).agg(
        F.count("*").alias("n_masks"), percent("thin"), percent("deep"), percent("has_z_gap"),
        F.median("z_span").alias("median_z_span"), F.max("z_span").alias("max_z_span"), F.count("jitter").alias("n_with_jitter"),
        F.median("jitter").alias("median_jitter"), F.percentile("jitter", F.lit(0.9)).alias("p90_jitter"), F.median("n_reversals").alias("median_reversals"),
        F.median("sway").alias("median_sway"), F.percentile("sway", F.lit(0.9)).alias("p90_sway"),
        ratio(100.0 * F.count_if("large_jitter"), F.count("jitter")).alias("pct_jittery"), ratio(100.0 * F.count_if("large_sway"), F.count("sway")).alias("pct_swayed"),
    )
    if brightness is not None:
        out = out.join(brightness, list(keys), "left")
    if filters is not None:
        out = out.join(filters.select(*keys, "n_total", "n_dropped", "pct_dropped"), list(keys), "left")
    return out


def score_fovs(metrics: DataFrame, weights: Mapping[str, float] | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Lines of the card and their weighted total; a missing line takes its weight with it; nothing is clipped."""
    weights = SCORE_WEIGHTS if weights is None else weights
    lines = {"Span": 1 - F.col("pct_thin") / 100, "Jitter": 1 - F.col("pct_jittery") / 100, "Sway": 1 - F.col("pct_swayed") / 100}
    lines["Signal"] = F.col("separability") if "separability" in metrics.columns else F.lit(None).cast("double")
    out = metrics.select(*keys, *(c.alias(n) for n, c in lines.items()))
    used = [(n, w) for n, w in weights.items() if n in lines]
    earned = reduce(add, (F.coalesce(F.col(n) * w, F.lit(0.0)) for n, w in used), F.lit(0.0))
    held = reduce(add, (F.when(F.col(n).isNotNull(), F.lit(float(w))).otherwise(0.0) for n, w in used), F.lit(0.0))
    return out.withColumn("Total", F.when(held > 0, earned / held))


def scorecard(voxels: DataFrame, weights: Mapping[str, float] | None = None, with_brightness: bool = True) -> DataFrame:
    """From voxels to scores."""
    s = scan(voxels)
    return score_fovs(fov_metrics(s.measures, s.brightness if with_brightness else None, s.filters), weights)


def region_cards(scores: DataFrame) -> dict[str, DataFrame]:
    """One card for each region; a field's scores do not depend on the grouping."""
    return {r.region: scores.where(F.col("region") == r.region).drop("region") for r in scores.select("region").distinct().collect()}


def old_card(masks: DataFrame, filters: DataFrame, flagged: str = "large_jitter", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The earlier card: thinness counts thin and single-slice masks, stability the flagged ones."""
    own = masks.groupBy(*keys).agg((100.0 * F.avg(F.col("thin").cast("double"))).alias("t"), (100.0 * F.avg(F.col(flagged).cast("double"))).alias("f"))
    out = own.join(filters.select(*keys, "pct_single_slice"), list(keys), "left")
    return out.select(*keys, (1 - (F.col("t") + F.col("pct_single_slice")) / 100).alias("Thinness"), (1 - F.col("f") / 100).alias("Stability"))
