"""The queries of the driver contract: each name with its plan and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planewise.functions.columns import KEYS
from planewise.functions.constants import SCORE_WEIGHTS
from planewise.functions.storage import written
from planewise.operators import areas as A
from planewise.operators import brightness as B
from planewise.operators import change as C
from planewise.operators import cutoff as X
from planewise.operators import inference as I
from planewise.operators import profile as P
from planewise.operators import scorecard as S
from planewise.operators import selection as L
from planewise.operators import summaries as Z
from planewise.plans import sql as Q
from planewise.sources import catalog as G
from planewise.sources.fixtures import read, voxels
from planewise.streaming import areas as W

#: Label expressions: an object for each supplier; one for each supplier and group of parts; one for each order.
SUPPLIER, MIXED, ORDER = "l_suppkey", "l_suppkey * 1000 + l_partkey % 40", "l_orderkey"
CUTOFF, FINE_CUTOFF = 26.0, 50_000.0
SECTIONS = 4
CARD = ("Span", "Jitter", "Sway", "Signal", "Total")
OTHER_WEIGHTS = {"Span": 0.20, "Jitter": 0.30, "Sway": 0.20, "Signal": 0.30}
K = Q.K

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places and whole numbers to 64 bits, so that two engines' results can be compared."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType | T.FloatType | T.DecimalType):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.IntegerType | T.ShortType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        name = f.__name__
        PLANS[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _areas(s: SparkSession, d: str, label: str) -> DataFrame:
    return A.plane_areas(voxels(s, d, label))


def _spans(s: SparkSession, d: str, label: str) -> DataFrame:
    return A.span_table(_areas(s, d, label))


def _scan(s: SparkSession, d: str) -> S.Scan:
    return S.scan(voxels(s, d, MIXED), area_floor=1, sliver_frac=0.05)


def _hist(s: SparkSession, d: str, brightness: str = "int") -> DataFrame:
    v = voxels(s, d, SUPPLIER, brightness)
    return B.histograms(v, B.bin_edges(v))


SPAN_FLOATS, SPAN_INTS = "area_median", "z_start z_end n_planes area_min area_max n_voxels z_span"
BASE_MIXED = [Q.vox(MIXED), Q.AREAS, Q.spans(), Q.DROPPED, Q.KVOX, Q.KAREAS, Q.spans("kareas", "kspans"), Q.REPORT]
MASKS = [*BASE_MIXED, Q.planes("kareas", 1, 0.05), *Q.PROFILES, Q.masks("kspans")]
METRICS = [*MASKS, Q.METRICS]
LIGHT = [Q.EDGES, Q.hist("kvox"), Q.POOLED, *Q.BRIGHTNESS]
SCORES = [*METRICS, *LIGHT, *Q.scores(SCORE_WEIGHTS)]
HIST = [Q.vox(SUPPLIER), Q.EDGES, Q.hist()]
FINE = [Q.vox(SUPPLIER, "float"), Q.EDGES, Q.hist()]
POOL = [*HIST, Q.POOLED]
PROFILE = [Q.vox(SUPPLIER), Q.AREAS, Q.planes("areas", 3, 0.05), *Q.PROFILES]
PROFILE_INTS, PROFILE_FLOATS = "n_planes n_planes_used area_min area_max n_reversals z_at_jitter z_at_sway", "jitter sway"
STATS_FLOATS = "mean_masked mean_unmasked median_masked median_unmasked p25_masked p25_unmasked p75_masked p75_unmasked frac_masked auc point_biserial_r"
BRIGHT_FLOATS = "frac_masked separability mean_masked mean_unmasked median_masked median_unmasked median_shift_iqr dim_masked_rate bright_unmasked_rate point_biserial_r"
METRIC_FLOATS = "pct_thin pct_deep pct_z_gap median_z_span median_jitter p90_jitter median_reversals median_sway p90_sway pct_jittery pct_swayed"
MASK_INTS = SPAN_INTS + " n_planes_used n_reversals z_at_jitter z_at_sway"


@query(
    Q.query(
        PROFILE,
        "select method, count(*) as n_masks, median(jitter) as median_jitter, quantile_cont(jitter, 0.9) as p90_jitter, 100.0 * count(*) filter (where jitter > 1.75) / nullif(count(jitter), 0) as pct_jittery, median(sway) as median_sway from profile group by method",
        "median_jitter p90_jitter pct_jittery median_sway",
        "n_masks",
    )
)
def profile_by_method(s, d):
    p = P.flag_jitter(P.profiles(_areas(s, d, SUPPLIER), area_floor=3))
    sums = [F.count("*").alias("n_masks"), F.try_divide(100.0 * F.count_if("large_jitter"), F.count("jitter").cast("double")).alias("pct_jittery")]
    wanted = {"median_jitter": ("jitter", 0.5), "p90_jitter": ("jitter", 0.9), "median_sway": ("sway", 0.5)}
    return L.summarised(p, sums, wanted, ("method",), ("jitter", "sway", "large_jitter"))


@query(Q.query([Q.vox(SUPPLIER), Q.AREAS], "select * from areas", "", "z area"))
def plane_areas(s, d):
    return _areas(s, d, SUPPLIER)


@query(Q.query([Q.vox(MIXED), Q.AREAS, Q.spans()], "select * from spans", SPAN_FLOATS, SPAN_INTS))
def span_table(s, d):
    return _spans(s, d, MIXED)


@query(Q.query([Q.vox(MIXED), Q.AREAS, Q.spans()], f"select {K}, label, z_start, z_end, z_span, z_span > 3 as spans_multiple_layers from spans", "", "z_start z_end z_span"))
def check_z_span(s, d):
    return A.check_z_span(_areas(s, d, MIXED), 3)


@query(Q.query([Q.vox(ORDER), Q.AREAS, Q.spans(), Q.REPORT], "select * from report", "pct_dropped pct_single_slice", "n_total n_single_slice n_dropped"))
def single_slice_report(s, d):
    return A.filter_report(_spans(s, d, ORDER))


@query(Q.query([Q.vox(ORDER), Q.AREAS, Q.spans()], f"select {K}, count(*) as n_total, count(*) filter (where z_span = 1) as n_single_slice, case when method = 'F' then count(*) filter (where z_span = 1) else 0 end as n_dropped, 100.0 * count(*) filter (where z_span = 1) / count(*) as pct_dropped, 100.0 * count(*) filter (where z_span = 1) / count(*) as pct_single_slice from spans group by {K}", "pct_dropped pct_single_slice", "n_total n_single_slice n_dropped"))
def single_slice_report_one_technique(s, d):
    return A.filter_report(_spans(s, d, ORDER), drop_in=("F",))


@query(Q.query([Q.vox(ORDER), Q.AREAS, Q.spans(), Q.DROPPED, Q.KVOX], f"select {K}, count(*) as n_voxels, count(*) filter (where label > 0) as n_masked, count(distinct label) as n_labels from kvox group by {K}", "", "n_voxels n_masked n_labels"))
def relabelled_voxels_count(s, d):
    v = voxels(s, d, ORDER)
    kept = A.filter_single_slice(v, A.plane_areas(v))[0]
    return kept.groupBy(*KEYS).agg(F.count("*").alias("n_voxels"), F.count_if(F.col("label") > 0).alias("n_masked"), F.countDistinct("label").alias("n_labels"))


_shares = ", ".join(f"100.0 * count(*) filter (where least(z_span, 6) = {k}) / count(*) as span_{k}" for k in range(1, 7))


@query(Q.query([Q.vox(MIXED), Q.AREAS, Q.spans()], f"select method, {_shares} from spans group by method", " ".join(f"span_{k}" for k in range(1, 7))))
def span_distribution(s, d):
    return A.span_distribution(_spans(s, d, MIXED))


@query(Q.query([Q.vox(MIXED), Q.AREAS, Q.spans()], f"select *, z_span - n_planes as n_missing from spans where has_z_gap order by n_missing desc, z_span desc, {K}, label limit 10", SPAN_FLOATS, SPAN_INTS + " n_missing"))
def gapped_top10(s, d):
    return Z.worst_gapped(_spans(s, d, MIXED))


@query(Q.query([Q.vox(MIXED), Q.AREAS, Q.spans()], f"select v.method, s.z_span, count(*) as n from vox v join spans s using ({K}, label) where s.z_span in (6, 7) group by all", "", "z_span n"))
def span_layers(s, d):
    v = voxels(s, d, MIXED)
    return A.span_layers(v, A.span_table(A.plane_areas(v)), 6).groupBy("method", F.expr("cast(substring_index(layer, '_', -1) as int)").alias("z_span")).agg(F.count("*").alias("n"))


@query(Q.query([Q.vox(SUPPLIER), Q.AREAS, Q.planes("areas", 3, 0.05)], "select * from planes", "", "z area"))
def kept_planes(s, d):
    return P.kept_planes(_areas(s, d, SUPPLIER), 3)


@query(Q.query(PROFILE, f"select {K}, label, n_planes, n_planes_used, area_min, area_max, n_reversals, jitter, z_at_jitter, sway, z_at_sway from profile", PROFILE_FLOATS, PROFILE_INTS))
def jitter_and_sway(s, d):
    return P.profiles(_areas(s, d, SUPPLIER), 3)


@query(Q.query(MASKS, "select * from masks", SPAN_FLOATS + " jitter sway", MASK_INTS))
def mask_table(s, d):
    return _scan(s, d).masks


@query(Q.query(PROFILE, f"select {K}, label, jitter, coalesce(jitter > 1.75, false) as large_jitter from profile", "jitter"))
def flag_absolute(s, d):
    return P.flag_jitter(P.profiles(_areas(s, d, SUPPLIER), 3)).select(*KEYS, "label", "jitter", "large_jitter")


@query(Q.query(PROFILE, f"select {K}, label, sway, (select quantile_cont(sway, 0.9) from profile) as cutoff_sway, coalesce(sway > (select quantile_cont(sway, 0.9) from profile), false) as large_sway from profile", "sway cutoff_sway"))
def flag_quantile(s, d):
    return P.analyse_masks(_areas(s, d, SUPPLIER), area_floor=3).select(*KEYS, "label", "sway", "cutoff_sway", "large_sway")


@query(Q.query(PROFILE, f"select {K}, label, jitter from profile where jitter is not null order by jitter desc, {K}, label limit 10", "jitter"))
def worst_jitter_top10(s, d):
    return Z.worst(P.profiles(_areas(s, d, SUPPLIER), 3), "jitter").select(*KEYS, "label", "jitter")


@query(Q.query(HIST, "select * from edges", "lo width", "n_bins"))
def bin_edges_exact(s, d):
    return B.bin_edges(voxels(s, d))


@query(Q.query(FINE, "select * from edges", "lo width", "n_bins"))
def bin_edges_float(s, d):
    return B.bin_edges(voxels(s, d, SUPPLIER, "float"))


@query(Q.query(HIST, f"select {K}, z, masked, bin, n from hist", "", "z bin n"))
def hist_exact(s, d):
    return _hist(s, d).select(*KEYS, "z", "masked", "bin", "n")


@query(Q.query(FINE, f"select {K}, z, masked, bin, n from hist", "", "z bin n"))
def hist_float(s, d):
    return _hist(s, d, "float").select(*KEYS, "z", "masked", "bin", "n")


@query(Q.query([*POOL, Q.quantiles("pooled", f"{K}, masked", {"q25": 0.25, "q50": 0.5, "q90": 0.9})], "select * from quants", "q25 q50 q90"))
def hist_quantiles(s, d):
    return B.quantiles(B.pooled(_hist(s, d)), {"q25": 0.25, "q50": 0.5, "q90": 0.9}, (*KEYS, "masked"))


@query(Q.query(POOL, f"select {K}, masked, sum(n * least(greatest((20.3 - (lo + bin * width)) / width, 0), 1)) / sum(n) as share from pooled group by all", "share"))
def hist_cdf(s, d):
    pool = B.pooled(_hist(s, d))
    return B.cdf_at(pool, pool.select(*KEYS, "masked").distinct().withColumn("point", F.lit(20.3)), (*KEYS, "masked"), "share")


@query(Q.query(POOL, f"select {K}, masked, sum(n * {Q.CENTRE}) / sum(n) as mean, sqrt(sum(n * {Q.CENTRE} * {Q.CENTRE}) / sum(n) - pow(sum(n * {Q.CENTRE}) / sum(n), 2)) as sd from pooled group by all", "mean sd"))
def hist_moments(s, d):
    return B.moments(B.pooled(_hist(s, d)), (*KEYS, "masked"))


@query(Q.query([*POOL, Q.sides("pooled", K), Q.auc("sides", K)], "select * from aucs", "auc"))
def hist_auc(s, d):
    return B.auc(B.groups(B.pooled(_hist(s, d)), KEYS), KEYS)


@query(Q.query([*POOL, Q.sides("pooled", K), Q.biserial(K)], "select * from biserials", "point_biserial_r"))
def hist_point_biserial(s, d):
    return B.point_biserial(B.pooled(_hist(s, d)), KEYS)


@query(Q.query([*HIST, *Q.group_stats("hist", f"{K}, z")], "select * from stats", STATS_FLOATS, "z n_pixels n_masked"))
def stats_by_z(s, d):
    return B.summarise_by_z(_hist(s, d))


_levels = Q.query([*HIST, *Q.group_stats("hist", K)], "select *, -1 as z from stats", STATS_FLOATS, "z n_pixels n_masked")


@query(f"select *, false as all_planes from ({SQL['stats_by_z']}) a union all by name select *, true as all_planes from ({_levels}) b")
def stats_levels(s, d):
    return B.summarise_levels(_hist(s, d))


@query(Q.query([*FINE, *Q.group_stats("hist", K)], "select * from stats", STATS_FLOATS, "n_pixels n_masked"))
def stats_pooled(s, d):
    return B.summarise_pooled(_hist(s, d, "float"))


@query(Q.query([*BASE_MIXED, *LIGHT], "select * from brightness", BRIGHT_FLOATS, "n_voxels n_masked"))
def brightness_stats(s, d):
    return _scan(s, d).brightness


_ends = Q.stage("ends", "select 5.0 as new_lo, 3.0 as new_width, 10 as new_bins")


def _coarse(s: SparkSession) -> DataFrame:
    return s.range(1).select(F.lit(5.0).alias("new_lo"), F.lit(3.0).alias("new_width"), F.lit(10).alias("new_bins"))


@query(Q.query([*POOL, _ends], f"select {K}, masked, cast(least(greatest(floor(({Q.CENTRE} - new_lo) / new_width), 0), new_bins - 1) as bigint) as bin, new_lo as lo, new_width as width, sum(n) as n from pooled, ends group by all", "lo width", "n"))
def rebin_fold(s, d):
    return B.rebin(B.pooled(_hist(s, d)), _coarse(s), (*KEYS, "masked"), ())


@query(Q.query([*POOL, _ends], f"select {K}, masked, cast(least(floor(({Q.CENTRE} - new_lo) / new_width), new_bins - 1) as bigint) as bin, new_lo as lo, new_width as width, sum(n) as n from pooled, ends where {Q.CENTRE} >= new_lo and {Q.CENTRE} <= new_lo + new_width * new_bins group by all", "lo width", "n"))
def rebin_drop(s, d):
    return B.rebin(B.pooled(_hist(s, d)), _coarse(s), (*KEYS, "masked"), (), fold=False)


@query(Q.query([*POOL, Q.stage("ends", "select min(lo + bin * width) as new_lo, (max(lo + bin * width + width) - min(lo + bin * width)) / 64 as new_width, 64 as new_bins from pooled")], f"select method, masked, cast(least(greatest(floor(({Q.CENTRE} - new_lo) / new_width), 0), new_bins - 1) as bigint) as bin, sum(n) as n from pooled, ends group by all", "", "n"))
def pooled_runs(s, d):
    return B.pool_runs(B.pooled(_hist(s, d)), 64).select("method", "masked", "bin", "n")


_display = [*POOL, Q.stage("flat", f"select {K}, bin, lo, width, sum(n) as n from pooled group by all"), Q.quantiles("flat", K, {"hi": 0.999})]


@query(Q.query(_display, f"select {K}, new_lo, (case when hi > new_lo then hi else new_lo + 1 end - new_lo) / 60 as new_width, 60 as new_bins from (select {K}, min(lo + bin * width) as new_lo from flat where n > 0 group by all) join quants using ({K})", "new_lo new_width", "new_bins"))
def display_edges(s, d):
    return B.display_edges(B.pooled(_hist(s, d)), KEYS)


@query(Q.query(POOL, "select method, masked, bin, sum(n) as n, sum(n) / cast(sum(sum(n)) over (partition by method, masked) as double) as share from pooled group by method, masked, bin", "share", "n"))
def brightness_distribution(s, d):
    return B.distribution(B.pooled(_hist(s, d)).groupBy("method", "masked", "bin").agg(F.sum("n").alias("n")))


_cutting = Q.stage("cutting", f"select {K}, min(lo) as new_lo, (coalesce(min(case when share >= 0.999 then c end), max(c)) - min(lo)) / 120 as new_width, 120 as new_bins from (select *, {Q.CENTRE} as c, sum(n) over (partition by {K} order by bin) / sum(n) over (partition by {K}) as share from flat) r group by {K}")
_last = f"{Q.CENTRE} = new_lo + new_width * new_bins"


@query(Q.query([*POOL, _display[len(POOL)], _cutting], f"select {K}, masked, cast(case when {_last} then new_bins - 1 else floor(({Q.CENTRE} - new_lo) / new_width) end as bigint) as bin, new_lo as lo, new_width as width, sum(n) as n from pooled join cutting using ({K}) where {_last} or floor(({Q.CENTRE} - new_lo) / new_width) between 0 and new_bins - 1 group by all", "lo width", "n"))
def display_bins(s, d):
    return B.display_bins(B.pooled(_hist(s, d)))


@query(Q.query([*_display, Q.stage("shown", f"select {K}, new_lo, (case when hi > new_lo then hi else new_lo + 1 end - new_lo) / 60 as new_width, 60 as new_bins from (select {K}, min(lo + bin * width) as new_lo from flat where n > 0 group by all) e join quants using ({K})")], f"select {K}, masked, sum(n) as n, sum(case when lo + bin * width >= new_lo + new_width * new_bins then n else 0 end) as n_over from pooled join shown using ({K}) group by all", "", "n n_over"))
def display_overflow(s, d):
    pool = B.pooled(_hist(s, d))
    return B.overflow(pool, B.display_edges(pool, KEYS), (*KEYS, "masked"), KEYS)


@query(Q.query([*_display, Q.stage("shown", f"select min(new_lo) as new_lo, max(new_lo + new_width * 60) as hi from (select new_lo, (case when hi > new_lo then hi else new_lo + 1 end - new_lo) / 60 as new_width from (select {K}, min(lo + bin * width) as new_lo from flat where n > 0 group by all) e join quants using ({K})) f")], "select new_lo, (hi - new_lo) / 60 as new_width, 60 as new_bins from shown", "new_lo new_width", "new_bins"))
def display_range(s, d):
    return B.display_range(B.pooled(_hist(s, d)), KEYS)


_layers = Q.stage("t", f"select {K}, max(case when masked then q end) as mt, max(case when not masked then q end) as ut from quants group by {K}")


@query(Q.query([*POOL, Q.quantiles("pooled", f"{K}, masked", {"q": 0.5}), _layers], f"select {K}, case when label > 0 then 'dim_masked' else 'bright_unmasked' end as layer, count(*) as n from vox join t using ({K}) where case when label > 0 then brightness <= ut else brightness >= mt end group by all", "", "n"))
def overlay_quantile(s, d):
    v = voxels(s, d)
    return B.overlap_layers(v, B.histograms(v, B.bin_edges(v))).groupBy(*KEYS, "layer").agg(F.count("*").alias("n"))


@query(Q.query([Q.vox(SUPPLIER)], f"select {K}, case when label > 0 then 'masked_below' else 'unmasked_above' end as layer, count(*) as n from vox where case when label > 0 then brightness < {CUTOFF} else brightness >= {CUTOFF} end group by all", "", "n"))
def overlay_cutoff(s, d):
    return X.cutoff_layers(voxels(s, d), CUTOFF).groupBy(*KEYS, "layer").agg(F.count("*").alias("n"))


_flags = " union all ".join(f"select {K}, label, '{n}' as layer from masks where {c}" for n, c in {"thin": "thin", "deep": "deep", "z_gap": "has_z_gap", "jitter": "large_jitter", "sway": "large_sway"}.items())


@query(Q.query([*MASKS, Q.stage("flags", _flags)], f"select {K}, layer, count(*) as n from vox join flags using ({K}, label) group by all", "", "n"))
def flag_layers(s, d):
    return X.flag_layers(voxels(s, d, MIXED), _scan(s, d).measures, KEYS).groupBy(*KEYS, "layer").agg(F.count("*").alias("n"))


_defects = f"select {K}, layer from vox join flags using ({K}, label) union all select {K}, 'dropped' from vox join dropped using ({K}, label) union all select {K}, case when label > 0 then 'dim_masked' else 'bright_unmasked' end from kvox join t using ({K}) where case when label > 0 then brightness <= ut else brightness >= mt end"


@query(Q.query([*MASKS, Q.stage("flags", _flags), Q.EDGES, Q.hist("kvox"), Q.POOLED, Q.quantiles("pooled", f"{K}, masked", {"q": 0.5}), _layers], f"select {K}, layer, count(*) as n from ({_defects}) l group by all", "", "n"))
def defect_layers(s, d):
    c = _scan(s, d)
    return X.defect_layers(c.voxels, c.measures, c.dropped, c.hist).groupBy(*KEYS, "layer").agg(F.count("*").alias("n"))


def _split(cut: float) -> str:
    point = f"case when abs(width - 1) < 1e-8 and abs(lo - floor(lo) - 0.5) < 1e-8 then {cut} - 0.5 else {cut} end"
    return Q.stage("split", f"select *, n * w as below, n * (1 - w) as above from (select *, least(greatest(({point} - (lo + bin * width)) / width, 0), 1) as w from pooled) s")


_within = "select region, fov, method, case when masked then 'masked' else 'unmasked' end as \"group\", 100.0 * sum(below) / sum(n) as pct_below, 100.0 * sum(above) / sum(n) as pct_above, sum(below) / sum(n) as auc_below, sum(above) / sum(n) as auc_above from split group by all"


@query(Q.query([*POOL, _split(CUTOFF)], _within, "pct_below pct_above auc_below auc_above"))
def cutoff_within(s, d):
    return X.cutoff_within(B.pooled(_hist(s, d)), CUTOFF)


@query(Q.query([*FINE, Q.POOLED, _split(FINE_CUTOFF)], _within, "pct_below pct_above auc_below auc_above"))
def cutoff_within_float(s, d):
    return X.cutoff_within(B.pooled(_hist(s, d, "float")), FINE_CUTOFF)


@query(Q.query([*BASE_MIXED, Q.EDGES, Q.hist("kvox"), Q.POOLED, _split(CUTOFF)], _within, "pct_below pct_above auc_below auc_above"))
def cutoff_within_filtered(s, d):
    """After the single-slice filter: removed voxels count as unmasked."""
    return X.cutoff_within(B.pooled(_scan(s, d).hist), CUTOFF)


_by = "region, fov, masked"
_both = Q.stage("pair", f"select {_by}, bin, sum(case when method = 'F' then below else 0 end) as ba, sum(case when method = 'F' then above else 0 end) as aa, sum(case when method = 'O' then below else 0 end) as bb, sum(case when method = 'O' then above else 0 end) as ab from split group by all")
_low, _high = (Q.stage(n, f"select {_by}, bin, {a} as a, {b} as b from pair") for n, a, b in (("low", "ba", "bb"), ("high", "aa", "ab")))


@query(
    Q.query(
        [*POOL, _split(CUTOFF), _both, _low, _high, Q.auc("low", _by, "auc1", "auc_below"), Q.auc("high", _by, "auc2", "auc_above")],
        f"select region, fov, case when masked then 'masked' else 'unmasked' end as \"group\", 'F' as method_a, 'O' as method_b, 100.0 * sum(aa) / sum(aa + ba) as pct_above_a, 100.0 * sum(ab) / sum(ab + bb) as pct_above_b, 100.0 * sum(aa) / sum(aa + ba) - 100.0 * sum(ab) / sum(ab + bb) as d_pct_above, any_value(auc_below) as auc_below, any_value(auc_above) as auc_above from pair join auc1 using ({_by}) join auc2 using ({_by}) group by region, fov, masked having sum(aa + ba) > 0 and sum(ab + bb) > 0",
        "pct_above_a pct_above_b d_pct_above auc_below auc_above",
    )
)
def cutoff_across(s, d):
    return X.cutoff_across(B.pooled(_hist(s, d)), CUTOFF)


@query(Q.query([Q.vox(SUPPLIER)], "select region, fov, method from vox where fov in (select fov from vox group by region, fov having count(distinct method) = 2) group by all"))
def find_paired_fovs(s, d):
    found = voxels(s, d).select(*KEYS).distinct().withColumn("method_ord", F.when(F.col("method") == "F", 0).otherwise(1))
    return G.find_region_fovs(found, 2).select(*KEYS)


@query(Q.query([Q.vox(SUPPLIER)], "select region from vox group by region having count(distinct method) = 2"))
def available_regions(s, d):
    return G.available_regions(voxels(s, d).select("region", "method"), 2)


@query(Q.query([*METRICS, *LIGHT], f"select m.*, b.* exclude ({K}), n_total, n_dropped, pct_dropped from metrics m left join brightness b using ({K}) left join report r using ({K})", METRIC_FLOATS + " " + BRIGHT_FLOATS + " pct_dropped", "n_masks max_z_span n_with_jitter n_voxels n_masked n_total n_dropped"))
def fov_metrics(s, d):
    c = _scan(s, d)
    return S.fov_metrics(c.measures, c.brightness, c.filters)


@query(Q.query(SCORES, "select * from scores", " ".join(CARD)))
def score_fovs(s, d):
    c = _scan(s, d)
    return S.score_fovs(S.fov_metrics(c.measures, c.brightness, c.filters))


@query(Q.query(SCORES, f"select * from scores where region = (select min(region) from scores)", " ".join(CARD)))
def region_card(s, d):
    """The card of the first region by name: the scores that its fields have among all."""
    cards = S.region_cards(S.score_fovs(S.fov_metrics((c := _scan(s, d)).measures, c.brightness, c.filters)))
    return cards[min(cards)].withColumn("region", F.lit(min(cards)))


@query(Q.query([*METRICS, *Q.scores(SCORE_WEIGHTS, signal=False)], "select * from scores", " ".join(CARD)))
def score_no_signal(s, d):
    return S.score_fovs(S.fov_metrics(_scan(s, d).measures))


@query(Q.query([*METRICS, *LIGHT, *Q.scores(OTHER_WEIGHTS)], "select * from scores", " ".join(CARD)))
def scorecard_other_weights(s, d):
    c = _scan(s, d)
    return S.score_fovs(S.fov_metrics(c.measures, c.brightness), OTHER_WEIGHTS)


def _change(metric: str, body: str, floats: str, ints: str) -> str:
    return Q.query([Q.vox(SUPPLIER), Q.AREAS, Q.change(metric)], body, floats, ints)


_CHANGE = ("frac_change abs_frac_change sym_frac_change change_floor log_change", "z_from z_to area_from area_to delta_area")


@query(_change("abs_frac_change", "select * from changes", *_CHANGE))
def area_change(s, d):
    return C.area_change(_areas(s, d, SUPPLIER))


@query(_change("sym_frac_change", "select * from changes", *_CHANGE))
def area_change_symmetric(s, d):
    return C.area_change(_areas(s, d, SUPPLIER), "sym_frac_change")


@query(_change("abs_frac_change", f"select {K}, z_from, z_to, avg(abs_frac_change) as mean_change, stddev_samp(abs_frac_change) as std_change, median(abs_frac_change) as median_change, avg(log_change) as mean_log_change, count(*) as n_objects, count(*) filter (where abs_frac_change > 1.0) as n_flagged, pow(10.0, avg(log_change)) as geo_mean_change, count(*) filter (where abs_frac_change > 1.0) / cast(count(*) as double) as frac_flagged from changes group by all", "mean_change std_change median_change mean_log_change geo_mean_change frac_flagged", "z_from z_to n_objects n_flagged"))
def layer_change(s, d):
    return C.layer_change(C.area_change(_areas(s, d, SUPPLIER)))


def _objects(stat: str) -> str:
    inner = f"select {K}, label, count(*) as n_transitions, avg(abs_frac_change) as mean_abs_change, max(abs_frac_change) as max_abs_change, avg(log_change) as mean_log_change, max(log_change) as max_log_change from changes group by all"
    return _change("abs_frac_change", f"select *, {stat}_log_change as log_change, pow(10.0, {stat}_log_change) as change_stat, {stat}_log_change > log10(1.0) as large_area_change from ({inner}) o", "mean_abs_change max_abs_change mean_log_change max_log_change log_change change_stat", "n_transitions")


@query(_objects("max"))
def object_outliers_max(s, d):
    return C.object_outliers(C.area_change(_areas(s, d, SUPPLIER)))


@query(_objects("mean"))
def object_outliers_mean(s, d):
    return C.object_outliers(C.area_change(_areas(s, d, SUPPLIER)), statistic="mean")


@query(_change("abs_frac_change", f"select {K}, label, z, count(*) as n from vox where ({K}, label) in (select ({K}, label) from changes where log_change > log10(1.0)) group by all", "", "z n"))
def change_layer(s, d):
    v = voxels(s, d, SUPPLIER)
    objects = C.object_outliers(C.area_change(A.plane_areas(v)))
    return C.change_layer(v, objects).groupBy(*KEYS, "label", "z").agg(F.count("*").alias("n"))


@query(_change("abs_frac_change", "select method, count(*) as n, avg(abs_frac_change) as mean_change, median(abs_frac_change) as median_change, pow(10.0, avg(log_change)) as geo_mean_change, count(*) filter (where abs_frac_change > 1.0) as n_over, count(*) filter (where abs_frac_change = 0) as n_zero, count(*) filter (where sym_frac_change > 1.0) as n_over_sym from changes group by method", "mean_change median_change geo_mean_change", "n n_over n_zero n_over_sym"))
def change_summary(s, d):
    return C.change_summary(C.area_change(_areas(s, d, SUPPLIER)))


@query(_change("abs_frac_change", "select least(greatest(pow(10.0, floor(log10(least))), top / 10000), top / 10, 0.1) as lo, top as hi from (select greatest(max(abs_frac_change), 1.2) as top, min(abs_frac_change) filter (where abs_frac_change > 0) as least from changes) e", "lo hi", ""))
def change_axis(s, d):
    return C.log_axis(C.area_change(_areas(s, d, SUPPLIER)))


@query(_change("abs_frac_change", f"select {K}, label, max(abs_frac_change / nullif(base, 0)) as ratio, coalesce(max(abs_frac_change / nullif(base, 0)) > 3.0, false) as outlier from changes join (select {K}, z_from, avg(abs_frac_change) as base from changes group by all) b using ({K}, z_from) group by {K}, label", "ratio", ""))
def relative_outliers(s, d):
    return C.relative_outliers(C.area_change(_areas(s, d, SUPPLIER)), 3.0)


_spread = "count(*) as n_objects, avg(abs_frac_change) as mean_change, quantile_cont(abs_frac_change, 0.25) as p25_change, quantile_cont(abs_frac_change, 0.75) as p75_change, stddev_samp(abs_frac_change) / sqrt(count(*)) as sem_change"
_SPREAD = ("mean_change p25_change p75_change sem_change", "z_from z_to n_objects")


@query(_change("abs_frac_change", f"select {K}, z_from, z_to, {_spread} from changes group by all", *_SPREAD))
def layer_spread(s, d):
    return C.layer_spread(C.area_change(_areas(s, d, SUPPLIER)))


@query(_change("abs_frac_change", f"select method, z_from, z_to, {_spread} from changes group by all", *_SPREAD))
def compare_layer_change(s, d):
    return C.compare_layer_change(C.area_change(_areas(s, d, SUPPLIER)))


@query(_change("abs_frac_change", "select 1.2 / 10000 as lo, 1.2 as hi from changes having count(*) > 0", "lo hi", ""))
def change_axis_without_changes(s, d):
    return C.log_axis(C.area_change(_areas(s, d, SUPPLIER)).where("abs_frac_change = 0"))


_axis = "(select least(greatest(pow(10.0, floor(log10(least))), top / 10000), top / 10, 0.1) as lo, top as hi from (select greatest(max(abs_frac_change), 1.2) as top, min(abs_frac_change) filter (where abs_frac_change > 0) as least from changes) e)"


@query(_change("abs_frac_change", f"select method, cast(least(floor(60 * log10(greatest(abs_frac_change, lo) / lo) / log10(hi / lo)), 59) as bigint) as bin, count(*) as n from changes, {_axis} x group by all", "", "n"))
def change_histogram(s, d):
    return C.change_histogram(C.area_change(_areas(s, d, SUPPLIER)))


def _size(where: str) -> str:
    inner = f"select *, z - lag(z) over w as z_gap, lag(area) over w as previous from areas window w as (partition by {K}, label order by z)"
    return Q.query([Q.vox(MIXED), Q.AREAS], f"select *, area - previous as delta, 100.0 * (area - previous) / previous as pct_change from ({inner}) s where {where}", "pct_change", "z area z_gap previous delta")


@query(_size("z_gap = 1"))
def size_change_adjacent(s, d):
    return C.size_change(_areas(s, d, MIXED))


@query(_size("z_gap is not null"))
def size_change_all(s, d):
    return C.size_change(_areas(s, d, MIXED), adjacent_only=False)


def _scores(s: SparkSession, d: str) -> DataFrame:
    c = _scan(s, d)
    return S.score_fovs(S.fov_metrics(c.measures, c.brightness))


PAIRS = [*SCORES, Q.pairs(CARD)]


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return written(I.paired(_scores(s, d), "F", "O", CARD))


@query(Q.query(PAIRS, "select metric, count(*) as n_pairs, median(x) as median_a, median(y) as median_b, median(diff) as median_diff from pairs group by metric", "median_a median_b median_diff", "n_pairs"))
def paired_medians(s, d):
    return I.paired_medians(_pairs(s, d))


@query(Q.query(PAIRS, "select a.metric, median((a.diff + b.diff) / 2) as hl_shift from pairs a join pairs b on a.metric = b.metric and (a.region, a.fov) <= (b.region, b.fov) group by a.metric", "hl_shift"))
def hodges_lehmann(s, d):
    return I.hodges_lehmann(_pairs(s, d))


@query(
    Q.query(
        [*PAIRS, Q.stage("ranked", "select *, rank() over (partition by metric order by abs(diff)) + (count(*) over (partition by metric, abs(diff)) - 1) / 2.0 as r from pairs where diff <> 0")],
        "select metric, (sum(case when diff > 0 then r else 0 end) - sum(case when diff < 0 then r else 0 end)) / sum(r) as rank_biserial from ranked group by metric",
        "rank_biserial",
    )
)
def rank_biserial(s, d):
    return I.rank_biserial(_pairs(s, d))


_ranked = Q.stage("ranked", "select *, rank() over (partition by metric order by abs(diff)) + (count(*) over (partition by metric, abs(diff)) - 1) / 2.0 as r from pairs where diff <> 0")
_exact = [
    *PAIRS, _ranked,
    Q.stage("hl", "select a.metric, median((a.diff + b.diff) / 2) as hl_shift from pairs a join pairs b on a.metric = b.metric and (a.region, a.fov) <= (b.region, b.fov) group by a.metric"),
    Q.stage("rb", "select metric, (sum(case when diff > 0 then r else 0 end) - sum(case when diff < 0 then r else 0 end)) / sum(r) as rank_biserial from ranked group by metric"),
    Q.stage("med", "select metric, count(*) as n_pairs, median(x) as median_a, median(y) as median_b, median(diff) as median_diff from pairs group by metric"),
]


@query(Q.query(_exact, "select m.*, hl_shift, rank_biserial, case when median_diff > 0 then 'O' when median_diff < 0 then 'F' else '' end as better from med m left join hl using (metric) left join rb using (metric)", "median_a median_b median_diff hl_shift rank_biserial", "n_pairs"))
def compare_techniques_exact(s, d):
    """All of the comparison that is not resampled; all lines of the card are better when they are higher."""
    return I.compare_exactly(_pairs(s, d), "F", "O").drop("p_wilcoxon")


#: Metrics of which less is better, and of which neither is, with one of which more is.
DIRECTIONS = {"pct_thin": -1, "median_jitter": -1, "p90_sway": -1, "n_masks": 0, "n_with_jitter": 0, "separability": 1}
_better = " ".join(f"when metric = '{m}' then {p}" for m, p in DIRECTIONS.items())
_directions = [*METRICS, *LIGHT, Q.stage("lined", f"select * from metrics left join brightness using ({K})"), Q.pairs(tuple(DIRECTIONS), "lined"), *_exact[len(PAIRS) :]]


@query(Q.query(_directions, f"select m.*, hl_shift, rank_biserial, case when median_diff * (case {_better} end) > 0 then 'O' when median_diff * (case {_better} end) < 0 then 'F' else '' end as better from med m left join hl using (metric) left join rb using (metric)", "median_a median_b median_diff hl_shift rank_biserial", "n_pairs"))
def compare_metrics_exact(s, d):
    """The same of metrics of all three directions."""
    scan = _scan(s, d)
    table = S.fov_metrics(scan.measures, scan.brightness, scan.filters)
    return I.compare_exactly(written(I.paired(table, "F", "O", tuple(DIRECTIONS))), "F", "O").drop("p_wilcoxon")


@query()
def compare_techniques(s, d):
    return I.compare_techniques(_scores(s, d), "F", "O", CARD)


@query()
def technique_summary(s, d):
    return I.technique_summary(_scores(s, d))


@query(Q.query([Q.vox(MIXED), Q.AREAS, Q.spans()], f"select {K}, count(*) as n_labels, 100.0 * avg((z_span > 1)::int) as pct_multi_layer, avg(z_span) as mean_z_span, max(z_span) as max_z_span, count(*) filter (where has_z_gap) as n_with_z_gaps from spans group by all", "pct_multi_layer mean_z_span", "n_labels max_z_span n_with_z_gaps"))
def volume_summary(s, d):
    return Z.volume_summary(_spans(s, d, MIXED))


@query(Q.query([Q.vox(MIXED), Q.AREAS, Q.spans()], "select concat_ws('/', region, method) as variant, count(*) as n_labels from spans group by all", "", "n_labels"))
def variant_column(s, d):
    return _spans(s, d, MIXED).groupBy(G.variant("region", "method")).agg(F.count("*").alias("n_labels"))


@query(Q.query([Q.vox(SUPPLIER), Q.stage("h", f"select {K}, max(y) + 1 as height from vox group by all")], f"select {K}, label, z, cast(floor(y * {SECTIONS} / cast(height as double)) as bigint) as section, count(*) as area from vox join h using ({K}) where label > 0 group by all", "", "z area"))
def section_areas(s, d):
    return Z.section_areas(voxels(s, d), SECTIONS)


@query(Q.query([*MASKS], f"select {K}, 1 - (100.0 * avg(thin::int) + any_value(pct_single_slice)) / 100 as Thinness, 1 - avg(large_jitter::int) as Stability from masks left join report using ({K}) group by {K}", "Thinness Stability"))
def old_card(s, d):
    c = _scan(s, d)
    return S.old_card(c.measures, c.filters)


_rates = Q.stage("rates", f"select {K}, count(*) as n_masks, 100.0 * avg((n_planes <= 2)::int) as thin_rate from spans group by all")


@query(Q.query([Q.vox(MIXED), Q.AREAS, Q.spans(), _rates], "select * from rates", "thin_rate", "n_masks"))
def thin_rate(s, d):
    return Z.thin_rate(_spans(s, d, MIXED))


@query(Q.query([Q.vox(MIXED), Q.AREAS, Q.spans(), _rates], "select method, avg(n_masks) as mean_yield, avg(thin_rate) as mean_thin_rate from rates group by method", "mean_yield mean_thin_rate"))
def thin_rate_centroids(s, d):
    return Z.centroids(Z.thin_rate(_spans(s, d, MIXED)))


@query(Q.query([Q.vox(MIXED), Q.AREAS, Q.spans(), _rates], "select avg(n_masks) filter (where method = 'O') - avg(n_masks) filter (where method = 'F') as d_yield, avg(thin_rate) filter (where method = 'O') - avg(thin_rate) filter (where method = 'F') as d_thin_rate from rates", "d_yield d_thin_rate"))
def centroid_shift(s, d):
    return Z.centroid_shift(Z.thin_rate(_spans(s, d, MIXED)), "F", "O")


_summed = "count(*) as n_labels, 100.0 * avg((z_span > 1)::int) as pct_multi_layer, avg(z_span) as mean_z_span, max(z_span) as max_z_span, count(*) filter (where has_z_gap) as n_with_z_gaps"


@query(Q.query([Q.vox(MIXED), Q.AREAS, Q.spans()], f"select {K}, 'region/fov/method' as level, {_summed} from spans group by all union all by name select region, method, 'region/method' as level, {_summed} from spans group by all union all by name select method, 'method' as level, {_summed} from spans group by all", "pct_multi_layer mean_z_span", "n_labels max_z_span n_with_z_gaps"))
def volume_levels(s, d):
    return Z.volume_levels(_spans(s, d, MIXED))


@query(Q.query([Q.vox(MIXED), Q.AREAS, Q.spans()], "select concat_ws('/', region, method) as variant, count(*) as n_labels, 100.0 * avg((z_span > 1)::int) as pct_multi_layer, avg(z_span) as mean_z_span, max(z_span) as max_z_span, count(*) filter (where has_z_gap) as n_with_z_gaps from spans group by all", "pct_multi_layer mean_z_span", "n_labels max_z_span n_with_z_gaps"))
def variant_summary(s, d):
    return Z.variant_summary(_spans(s, d, MIXED), ("region", "method"))


@query(Q.query([Q.vox(MIXED), Q.AREAS, Q.spans()], "select region, method, count(distinct fov) as n_fovs from spans group by all", "", "n_fovs"))
def coverage(s, d):
    return Z.coverage(_spans(s, d, MIXED))


@query(Q.query([Q.vox(MIXED), Q.AREAS, Q.spans()], "select method, count(*) as n_masks, quantile_cont(z_span, 0.25) as p25_z_span, quantile_cont(z_span, 0.5) as p50_z_span, quantile_cont(z_span, 0.75) as p75_z_span, max(z_span) as max_z_span from spans group by method", "p25_z_span p50_z_span p75_z_span", "n_masks max_z_span"))
def span_summary(s, d):
    return Z.span_summary(_spans(s, d, MIXED))


@query(Q.query([Q.vox(MIXED), Q.AREAS, Q.spans()], "select method, count(*) as n, count(*) filter (where z_span = 1) as n_single, count(*) filter (where z_span = 2) as n_double, count(*) filter (where z_span > 1) as n_over from spans group by method", "", "n n_single n_double n_over"))
def output_summary(s, d):
    return Z.output_summary(_spans(s, d, MIXED))


@query(Q.query([Q.vox(MIXED), Q.AREAS, Q.spans()], "select method, z_span, count(*) as n, count(*) / cast(sum(count(*)) over (partition by method) as double) as share from spans group by method, z_span", "share", "z_span n"))
def span_shares(s, d):
    return Z.span_shares(_spans(s, d, MIXED))


@query(Q.query(PROFILE, "select method, count(jitter) as n, quantile_cont(jitter, 0.5) as p50, quantile_cont(jitter, 0.75) as p75, quantile_cont(jitter, 0.9) as p90, quantile_cont(jitter, 0.95) as p95, quantile_cont(jitter, 0.99) as p99, max(jitter) as max, 100.0 * count(*) filter (where jitter > 1.75) / nullif(count(jitter), 0) as pct_over from profile group by method", "p50 p75 p90 p95 p99 max pct_over", "n"))
def profile_quantiles(s, d):
    return Z.profile_quantiles(P.profiles(_areas(s, d, SUPPLIER), 3), "jitter", 1.75)


@query(Q.query([*PROFILE, Q.stage("top", "select greatest(max(jitter), 1.3 * 1.75, 1.1) as t from profile"), Q.stage("binned", "select method, cast(least(floor(45 * log10(greatest(least(jitter, t), 1.0)) / log10(t)), 44) as bigint) as bin from profile, top where jitter is not null")], "select method, bin, count(*) as n, count(*) / cast(sum(count(*)) over (partition by method) as double) as share from binned group by method, bin", "share", "n"))
def log_distribution(s, d):
    return Z.log_distribution(P.profiles(_areas(s, d, SUPPLIER), 3), "jitter", 1.75)


@query(Q.query(PROFILE, "select method, median(jitter) as median, count(*) filter (where jitter is null) as n_null from profile group by method", "median", "n_null"))
def log_distribution_notes(s, d):
    return Z.log_distribution_notes(P.profiles(_areas(s, d, SUPPLIER), 3), "jitter")


@query(Q.query(PROFILE, f"select a.* from areas a join (select {K}, label from profile where sway is not null order by sway desc, {K}, label limit 10) w using ({K}, label)", "", "z area"))
def worst_profiles(s, d):
    areas = _areas(s, d, SUPPLIER)
    return Z.worst_profiles(areas, P.profiles(areas, 3), "sway")


@query(Q.query([Q.vox(ORDER), Q.AREAS, Q.spans(), Q.REPORT], "select method, count(*) as n_fovs, sum(n_total) as n_total, sum(n_dropped) as n_dropped, median(pct_dropped) as median_pct, min(pct_dropped) as min_pct, max(pct_dropped) as max_pct, 100.0 * sum(n_dropped) / sum(n_total) as pct_dropped from report group by method", "median_pct min_pct max_pct pct_dropped", "n_fovs n_total n_dropped"))
def filter_by_method(s, d):
    return Z.filter_by_method(A.filter_report(_spans(s, d, ORDER)))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 6) + 0.0 as total from events group by all")
def windowed_events(s, d):
    return W.windowed_events(read(s, d, "events"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From voxels to the scorecard, for all fields and techniques in one plan."""
    return PLANS["score_fovs"](spark, sf_dir)
