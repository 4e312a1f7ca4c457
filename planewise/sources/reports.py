"""From files to tables: what each analysis of one field, or of folders of them, prints, plots or writes.

Every report reads the blocks of its files where they are counted.  Tables come back as frames; ``save_tables`` writes them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewise.functions.columns import IMAGE, KEYS
from planewise.functions.constants import AREA_FLOOR, BRIGHTNESS_CUTOFF, CHANGE_CUTOFF, JITTER_CUTOFF, LAYER_SPAN_CUTOFF, SLIVER_FRAC, SWAY_CUTOFF
from planewise.functions.storage import written
from planewise.operators import areas as A
from planewise.operators import brightness as B
from planewise.operators import change as C
from planewise.operators import cutoff as X
from planewise.operators import inference as I
from planewise.operators import profile as P
from planewise.operators import scorecard as S
from planewise.operators import summaries as Z
from planewise.sources.regions import BlockScan, image_files, scan_regions

Tables = dict[str, DataFrame]
#: The lines of the card that techniques are compared on.
CARD = ("Span", "Jitter", "Sway", "Signal", "Total")


def field_scan(spark: SparkSession, masks: Mapping[str, str], image: str | None = None, region: str = "", fov: str = "", **how: object) -> BlockScan:
    """The scan of one field: a mask file for each technique, and the planes of its image by a pattern of paths."""
    if not masks:
        raise ValueError("no masks")
    rows = [(region, fov, method, path) for method, path in masks.items()]
    found = spark.createDataFrame(rows, "region string, fov string, method string, path string")
    planes = None if image is None else image_files(spark, image, region, fov)
    return BlockScan(found, planes, **how)


def span_report(spark: SparkSession, masks: Mapping[str, str], cutoff: int = LAYER_SPAN_CUTOFF, **how: object) -> Tables:
    """Bounding planes of every label, and how many span one, two and more than ``cutoff`` planes.  The filter is off."""
    areas = field_scan(spark, masks, drop=False, **how).areas
    return {"labels": A.check_z_span(areas, cutoff), "summary": Z.output_summary(A.span_table(areas), cutoff)}


def sway_report(spark: SparkSession, masks: Mapping[str, str], jitter_cutoff: float | None = JITTER_CUTOFF, sway_cutoff: float | None = SWAY_CUTOFF, area_floor: float = AREA_FLOOR, sliver_frac: float = SLIVER_FRAC, **how: object) -> Tables:
    """Profiles of all masks with jitter and sway flagged, quantiles of both, and the profiles of the worst."""
    s = field_scan(spark, masks, drop=False, **how)
    table = written(P.profiles(s.areas, area_floor, sliver_frac))
    out: Tables = {}
    for column, cutoff in (("jitter", jitter_cutoff), ("sway", sway_cutoff)):
        flagged = P.flag_metric(table, column, cutoff)
        limit = flagged.agg(F.max(f"cutoff_{column}")).first()[0] if cutoff is None else cutoff
        out |= {
            column: flagged,
            f"{column}_summary": Z.profile_quantiles(table, column, 1.0 if limit is None else limit),
            f"{column}_worst": Z.worst_profiles(s.areas, table, column),
            f"{column}_quiet": Z.quiet_sample(flagged, f"large_{column}"),
        }
    return out


def brightness_report(spark: SparkSession, masks: Mapping[str, str], image: str, **how: object) -> Tables:
    """Statistics of masked and unmasked voxels, pooled and by plane, with the shares that the plots draw.  The filter is off."""
    hist = field_scan(spark, masks, image, drop=False, **how).hist
    return {"per_z": B.summarise_by_z(hist), "pooled": B.summarise_pooled(hist), "thresholds": B.overlap_thresholds(hist), "bins": B.display_bins(hist)}


def change_report(spark: SparkSession, masks: Mapping[str, str], cutoff: float = CHANGE_CUTOFF, statistic: str = "max", metric: str = "abs_frac_change", span_cutoff: int = LAYER_SPAN_CUTOFF, **how: object) -> Tables:
    """Spans of all labels with their area changes, every change, and the changes by transition and in sum.  The filter is off."""
    areas = field_scan(spark, masks, drop=False, **how).areas
    changes = written(C.area_change(areas, metric))
    labels = A.check_z_span(areas, span_cutoff).join(C.object_outliers(changes, cutoff, statistic, metric), [*KEYS, "label"], "left")
    return {
        "labels": labels.fillna(False, ["large_area_change"]),
        "changes": changes,
        "layers": C.layer_change(changes, cutoff, metric),
        "summary": C.change_summary(changes, cutoff, metric),
        "bins": C.change_histogram(changes, cutoff, metric=metric),
    }


def cutoff_report(spark: SparkSession, masks: Mapping[str, str], image: str, cutoff: float = BRIGHTNESS_CUTOFF, **how: object) -> Tables:
    """Areas of the brightness curves either side of the cutoff, within each technique and between them."""
    s = field_scan(spark, masks, image, **how)
    within, across = X.cutoff_report(s.hist, cutoff)
    return {"within": within, "across": across, "filter": s.filters}


def region_report(spark: SparkSession, technique_roots: Mapping[str, str], image_roots: Mapping[str, str] | None = None, weights: Mapping[str, float] | None = None, n_boot: int = 10000, **how: object) -> Tables:
    """Folders of all techniques and regions to masks, metrics, scores, and the comparison of the first two techniques."""
    s = scan_regions(spark, technique_roots, image_roots, **how)
    metrics = written(S.fov_metrics(s.masks, None if image_roots is None else s.brightness, s.filters))
    scores = written(S.score_fovs(metrics, weights))
    out = {"masks": s.masks, "metrics": metrics, "scores": scores, "filter": Z.filter_by_method(s.filters), "summary": I.technique_summary(scores, CARD, n_boot)}
    if image_roots is not None:
        out["brightness"] = B.pool_runs(s.hist)
    if len(technique_roots) > 1:
        a, b = list(technique_roots)[:2]
        numbers = tuple(c for c, kind in metrics.dtypes if c not in (*IMAGE, "method") and kind in ("int", "bigint", "double"))
        out["comparison"] = I.compare_techniques(metrics.join(scores, [*KEYS]), a, b, (*numbers, *CARD), n_boot)
    return out


def save_tables(tables: Tables, stem: str, mode: str = "error") -> None:
    """Each table as CSV with header at ``<stem>_<name>``; what is there already is an error unless asked for."""
    for name, table in tables.items():
        table.write.mode(mode).option("header", True).csv(f"{stem}_{name}")
