"""The operators once more as SQL for DuckDB, built from named common table expressions."""

from __future__ import annotations

from planewise.sources.fixtures import voxels_sql

K = "region, fov, method"


def stage(name: str, body: str) -> str:
    return f"{name} as ({body})"


def query(stages: list[str], body: str, floats: str = "", ints: str = "") -> str:
    """``body`` over the stages; listed columns become rounded doubles, or 64-bit integers."""
    change = [f"round(cast({c} as double), 6) + 0.0 as {c}" for c in floats.split()] + [f"cast({c} as bigint) as {c}" for c in ints.split()]
    star = f"* replace ({', '.join(change)})" if change else "*"
    return f"with {', '.join(stages)} select {star} from ({body}) result"


def vox(label: str, brightness: str = "int") -> str:
    return voxels_sql(label, brightness)


AREAS = stage("areas", f"select {K}, label, z, count(*) as area from vox where label > 0 group by all")


def spans(source: str = "areas", name: str = "spans") -> str:
    inner = f"select {K}, label, min(z) as z_start, max(z) as z_end, count(*) as n_planes, min(area) as area_min, median(area) as area_median, max(area) as area_max, sum(area) as n_voxels from {source} group by all"
    return stage(name, f"select *, z_end - z_start + 1 as z_span, n_planes < z_end - z_start + 1 as has_z_gap from ({inner}) s")


DROPPED = stage("dropped", f"select {K}, label from spans where z_span = 1")
KVOX = stage("kvox", "select v.region, v.fov, v.method, v.z, v.y, v.x, case when d.label is null then v.label else 0 end as label, v.brightness from vox v left join dropped d on v.region = d.region and v.fov = d.fov and v.method = d.method and v.label = d.label")
KAREAS = stage("kareas", f"select a.* from areas a join spans s using ({K}, label) where s.z_span > 1")
REPORT = stage("report", f"select {K}, count(*) as n_total, count(*) filter (where z_span = 1) as n_single_slice, count(*) filter (where z_span = 1) as n_dropped, 100.0 * count(*) filter (where z_span = 1) / count(*) as pct_dropped, 100.0 * count(*) filter (where z_span = 1) / count(*) as pct_single_slice from spans group by all")


def planes(source: str, floor: int, frac: float) -> str:
    return stage("planes", f"select *, area >= {floor} and area >= cast({frac} as double) * max(area) over (partition by {K}, label) as kept from {source}")


STEPS = stage(
    "steps",
    f"""select *, case when lz = z - 1 and nz = z + 1 then abs(nla - 2.0 * la + lla) end as corner,
  case when lz = z - 1 and nz = z + 1 and sign(la - lla) * sign(nla - la) < 0 then least(abs(la - lla), abs(nla - la)) end as depth
  from (select *, lag(z) over w as lz, lead(z) over w as nz, lag(la) over w as lla, lead(la) over w as nla
    from (select *, log10(cast(area as double)) as la from planes where kept) a window w as (partition by {K}, label order by z)) b""",
)
TOPS = stage("tops", f"select *, max(corner) over (partition by {K}, label) as mc, max(depth) over (partition by {K}, label) as md from steps")
PROFILE = stage(
    "profile",
    f"""select p.*, coalesce(t.n_reversals, 0) as n_reversals, t.jitter, coalesce(t.z_at_jitter, -1) as z_at_jitter, t.sway, coalesce(t.z_at_sway, -1) as z_at_sway from
  (select {K}, label, count(*) as n_planes, count(*) filter (where kept) as n_planes_used, min(area) as area_min, max(area) as area_max from planes group by all) p
  left join (select {K}, label, count(depth) as n_reversals, case when count(corner) > 0 then pow(10.0, coalesce(sum(depth), 0.0)) end as jitter,
    min(z) filter (where depth = md) as z_at_jitter, case when count(corner) > 0 then pow(10.0, max(corner)) end as sway, min(z) filter (where corner = mc) as z_at_sway
    from tops group by all) t using ({K}, label)""",
)
PROFILES = [STEPS, TOPS, PROFILE]


def masks(spans_name: str) -> str:
    return stage(
        "masks",
        f"""select s.*, s.z_span <= 2 as thin, s.z_span >= 6 as deep, p.n_planes_used, p.n_reversals, p.jitter, p.z_at_jitter, p.sway, p.z_at_sway,
  coalesce(p.jitter > 1.75, false) as large_jitter, coalesce(p.sway > 3.0, false) as large_sway from {spans_name} s left join profile p using ({K}, label)""",
    )


EDGES = stage(
    "edges",
    """select region, fov, case when e then a - 0.5 else a end as lo, case when e then 1.0 else (case when b > a then b else a + 1 end - a) / 4096 end as width,
  case when e then cast(b - a + 1 as int) else 4096 end as n_bins, e as exact
  from (select *, whole and b - a < 131072 as e from (select region, fov, min(brightness) as a, max(brightness) as b, bool_and(brightness = floor(brightness)) as whole from vox group by all) i) j""",
)


def hist(source: str = "vox") -> str:
    return stage("hist", f"select {K}, z, label > 0 as masked, cast(least(floor((brightness - lo) / width), n_bins - 1) as bigint) as bin, lo, width, exact, count(*) as n from {source} join edges using (region, fov) group by all")


POOLED = stage("pooled", f"select {K}, masked, bin, lo, width, exact, sum(n) as n from hist group by all")
CENTRE = "(lo + (bin + 0.5) * width)"


def quantiles(source: str, by: str, qs: dict[str, float], name: str = "quants") -> str:
    each = ", ".join(f"arg_min(lo + bin * width + width * ({q} * total - (upto - n)) / n, bin) filter (where upto >= {q} * total) as {c}" for c, q in qs.items())
    inner = f"select *, sum(n) over (partition by {by} order by bin) as upto, sum(n) over (partition by {by}) as total from {source}"
    return stage(name, f"select {by}, {each} from ({inner}) r group by {by}")


def auc(source: str, by: str, name: str = "aucs", column: str = "auc") -> str:
    inner = f"select *, coalesce(sum(b) over (partition by {by} order by bin rows between unbounded preceding and 1 preceding), 0) as below from {source}"
    return stage(name, f"select {by}, sum(a * (below + 0.5 * b)) / nullif(sum(a) * sum(b), 0) as {column} from ({inner}) r group by {by}")


def sides(source: str, by: str, name: str = "sides") -> str:
    return stage(name, f"select {by}, bin, lo, width, cast(sum(case when masked then n else 0 end) as double) as a, cast(sum(case when masked then 0 else n end) as double) as b from {source} group by all")


def biserial(by: str, source: str = "sides") -> str:
    inner = f"select {by}, sum(a) as n1, sum(b) as n0, sum(a * {CENTRE}) as s1, sum(b * {CENTRE}) as s0, sum((a + b) * {CENTRE} * {CENTRE}) as ss from {source} group by all"
    return stage("biserials", f"select {by}, (s1 / nullif(n1, 0) - s0 / nullif(n0, 0)) / nullif(sqrt(greatest(ss / (n1 + n0) - pow((s1 + s0) / (n1 + n0), 2), 0)), 0) * sqrt(n1 / (n1 + n0) * (1 - n1 / (n1 + n0))) as point_biserial_r from ({inner}) m")


def group_stats(source: str, by: str) -> list[str]:
    """Stages up to ``stats``."""
    own = stage("own", f"select {by}, masked, bin, lo, width, sum(n) as n from {source} group by all")
    numbers = stage("numbers", f"select {by}, masked, sum(n) as n, sum(n * {CENTRE}) / sum(n) as mean from own group by all")
    wide = ", ".join(f"max(case when {'' if m else 'not '}masked then {v} end) as {v}_{'masked' if m else 'unmasked'}" for v in ("mean", "median", "p25", "p75") for m in (True, False))
    merged = stage("wide", f"select {by}, sum(n) as n_pixels, coalesce(max(case when masked then n end), 0) as n_masked, {wide} from numbers join quants using ({by}, masked) group by {by}")
    final = stage("stats", f"select *, cast(n_masked as double) / n_pixels as frac_masked from wide join aucs using ({by}) join biserials using ({by})")
    return [own, quantiles("own", f"{by}, masked", {"median": 0.5, "p25": 0.25, "p75": 0.75}), numbers, merged, sides("own", by), auc("sides", by), biserial(by), final]


def cdf(source: str, where: str, point: str, name: str) -> str:
    share = f"least(greatest(({point} - (lo + bin * width)) / width, 0), 1)"
    return stage(name + "s", f"select {K}, case when max({point}) is not null then sum(n * {share}) / sum(n) end as {name} from {source} join stats using ({K}) where {where} group by {K}")


BRIGHTNESS = [
    *group_stats("pooled", K),
    cdf("pooled", "masked", "median_unmasked", "dim_masked_rate"),
    cdf("pooled", "not masked", "median_masked", "below_rate"),
    stage(
        "brightness",
        f"""select s.region, s.fov, s.method, n_pixels as n_voxels, n_masked, frac_masked, auc as separability, mean_masked, mean_unmasked, median_masked, median_unmasked,
  case when p75_unmasked - p25_unmasked > 0 then (median_masked - median_unmasked) / (p75_unmasked - p25_unmasked) end as median_shift_iqr,
  dim_masked_rate, 1.0 - below_rate as bright_unmasked_rate, point_biserial_r from stats s left join dim_masked_rates using ({K}) left join below_rates using ({K})""",
    ),
]
METRICS = stage(
    "metrics",
    f"""select {K}, count(*) as n_masks, 100.0 * avg(thin::int) as pct_thin, 100.0 * avg(deep::int) as pct_deep, 100.0 * avg(has_z_gap::int) as pct_z_gap,
  median(z_span) as median_z_span, max(z_span) as max_z_span, count(jitter) as n_with_jitter, median(jitter) as median_jitter, quantile_cont(jitter, 0.9) as p90_jitter,
  median(n_reversals) as median_reversals, median(sway) as median_sway, quantile_cont(sway, 0.9) as p90_sway,
  100.0 * count(*) filter (where large_jitter) / nullif(count(jitter), 0) as pct_jittery, 100.0 * count(*) filter (where large_sway) / nullif(count(sway), 0) as pct_swayed from masks group by all""",
)


def scores(weights: dict[str, float], signal: bool = True) -> list[str]:
    lines = stage("lines", f"select {K}, 1 - pct_thin / 100 as Span, 1 - pct_jittery / 100 as Jitter, 1 - pct_swayed / 100 as Sway, {'separability' if signal else 'cast(null as double)'} as Signal from metrics {f'left join brightness using ({K})' if signal else ''}")
    earned = " + ".join(f"coalesce({n} * {w}, 0)" for n, w in weights.items())
    held = " + ".join(f"case when {n} is null then 0 else {w} end" for n, w in weights.items())
    return [lines, stage("scores", f"select *, ({earned}) / nullif({held}, 0) as Total from lines")]


def change(metric: str) -> str:
    inner = f"select {K}, label, z as z_from, lead(z) over w as z_to, area as area_from, lead(area) over w as area_to from areas window w as (partition by {K}, label order by z)"
    return stage(
        "changes",
        f"""select *, log10(greatest({metric}, change_floor)) as log_change from (select *, area_to - area_from as delta_area, (area_to - area_from) / cast(area_from as double) as frac_change,
  abs(area_to - area_from) / cast(area_from as double) as abs_frac_change, abs(area_to - area_from) / cast(least(area_from, area_to) as double) as sym_frac_change, 0.5 / area_from as change_floor
  from ({inner}) s where z_to = z_from + 1) c""",
    )


def pairs(columns: tuple[str, ...], source: str = "scores") -> str:
    each = " union all ".join(f"select region, fov, '{c}' as metric, max(case when method = 'F' then {c} end) as x, max(case when method = 'O' then {c} end) as y from {source} group by all" for c in columns)
    return stage("pairs", f"select *, y - x as diff from ({each}) u where x is not null and y is not null")
