"""Brightness histograms and the statistics read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planewise.functions.columns import IMAGE, KEYS, ratio
from planewise.functions.constants import CLIP_QUANTILE, DISPLAY_BINS, FLOAT_BINS, MAX_EXACT_BINS, OVERLAP_QUANTILE
from planewise.functions.storage import written


def vectorise_pixels(voxels: DataFrame) -> DataFrame:
    """Each voxel with whether it is in a mask."""
    return voxels.withColumn("masked", F.col("label") > 0)


def bin_edges(voxels: DataFrame, n_bins: int = FLOAT_BINS, max_exact: int = MAX_EXACT_BINS, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """``lo``, ``width``, ``n_bins`` and ``exact`` of every image, shared by all techniques.

    Whole numbers over a short range get a bin for each value; else bins divide the range evenly, and a
    constant image is widened by 1.
    """
    return edges_of(voxels.groupBy(*keys).agg(*ends()), n_bins, max_exact, keys)


def ends(low: str = "brightness", high: str = "brightness", whole: str | None = None) -> list[Column]:
    """Aggregates ``low``, ``high`` and ``whole`` of a group's brightness, or of such aggregates of its parts."""
    integral = F.col("brightness") == F.floor("brightness") if whole is None else F.col(whole)
    return [F.min(low).alias("low"), F.max(high).alias("high"), F.bool_and(integral).alias("whole")]


def edges_of(ranges: DataFrame, n_bins: int = FLOAT_BINS, max_exact: int = MAX_EXACT_BINS, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """The bins for a row of ``ends`` for each image."""
    exact = F.col("whole") & (F.col("high") - F.col("low") < max_exact)
    top = F.when(F.col("high") > F.col("low"), F.col("high")).otherwise(F.col("low") + 1)
    return ranges.select(
        *keys,
        F.when(exact, F.col("low") - 0.5).otherwise(F.col("low")).alias("lo"),
        F.when(exact, F.lit(1.0)).otherwise((top - F.col("low")) / n_bins).alias("width"),
        F.when(exact, (F.col("high") - F.col("low") + 1).cast("int")).otherwise(F.lit(n_bins)).alias("n_bins"),
        exact.alias("exact"),
    )


def bin_of(value: Column, lo: Column, width: Column, n_bins: Column) -> Column:
    """The bin of a value: half open, but for the last."""
    return F.least(F.floor((value - lo) / width), n_bins - 1).cast("long")


def histograms(voxels: DataFrame, edges: DataFrame, keys: tuple[str, ...] = KEYS, image: tuple[str, ...] = IMAGE) -> DataFrame:
    """Counts by technique, plane, masked or not, and bin, with the bin's lower edge and width.

    The edges are a row for each image; counts are combined before the shuffle, without what an image's bins have in common.
    Edges are written first: while their size is unknown, voxels would be dealt out by image, of which there are few, and
    travel one by one.
    """
    edges = written(edges)
    binned = vectorise_pixels(voxels).join(edges, list(image)).withColumn("bin", bin_of(F.col("brightness"), F.col("lo"), F.col("width"), F.col("n_bins")))
    binned = binned.where((F.col("bin") >= 0) & (F.col("brightness") <= F.col("lo") + F.col("width") * F.col("n_bins")))
    counted = binned.groupBy(*keys, "z", "masked", "bin").agg(F.count("*").alias("n"))
    return counted.join(edges.select(*image, "lo", "width", "exact"), list(image)).select(*keys, "z", "masked", "bin", "lo", "width", "exact", "n")


def pooled(hist: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The same without planes."""
    return hist.groupBy(*keys, "masked", "bin", "lo", "width", "exact").agg(F.sum("n").alias("n"))


def left_edge() -> Column:
    return F.col("lo") + F.col("bin") * F.col("width")


def centre() -> Column:
    return F.col("lo") + (F.col("bin") + 0.5) * F.col("width")


def quantiles(hist: DataFrame, qs: dict[str, float], by: tuple[str, ...]) -> DataFrame:
    """Binned quantiles of each group: in the first bin that reaches the share, linear within it; 0 is the lowest edge."""
    w = Window.partitionBy(*by).orderBy("bin")
    run = hist.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))

    def at(q: float) -> Column:
        if q == 0:
            return F.min("lo")
        inside = left_edge() + F.col("width") * (q * F.col("total") - (F.col("upto") - F.col("n"))) / F.col("n")
        return F.min(F.when(F.col("upto") >= q * F.col("total"), F.struct("bin", inside.alias("v")))).getField("v")

    return run.where("n > 0").groupBy(*by).agg(*(at(q).alias(name) for name, q in qs.items()))


def cdf_at(hist: DataFrame, points: DataFrame, by: tuple[str, ...], name: str) -> DataFrame:
    """Share of each group at or below its ``point``: linear within the bin it falls in; null without point or counts."""
    share = F.least(F.greatest((F.col("point") - left_edge()) / F.col("width"), F.lit(0.0)), F.lit(1.0))
    own = hist.join(points, list(by))
    return own.groupBy(*by).agg(F.when(F.max("point").isNotNull(), ratio(F.sum(F.col("n") * share), F.sum("n"))).alias(name))


def moments(hist: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Weighted mean and population standard deviation of each group, in two passes over its bins."""
    mean = (F.sum(F.col("n") * centre()).over(Window.partitionBy(*by))) / F.sum("n").over(Window.partitionBy(*by))
    centred = hist.withColumn("mean", mean).withColumn("sq", F.col("n") * (centre() - F.col("mean")) * (centre() - F.col("mean")))
    return centred.groupBy(*by).agg(F.max("mean").alias("mean"), F.sqrt(ratio(F.sum("sq"), F.sum("n"))).alias("sd"))


def auc(pairs: DataFrame, by: tuple[str, ...], name: str = "auc") -> DataFrame:
    """P(a > b) + P(a = b) / 2 from counts ``a`` and ``b`` by bin; fractions are allowed; null if either is empty."""
    w = Window.partitionBy(*by).orderBy("bin")
    below = F.coalesce(F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    won = pairs.withColumn("won", F.col("a") * (below + 0.5 * F.col("b")))
    return won.groupBy(*by).agg(F.try_divide(F.sum("won"), F.sum("a").cast("double") * F.sum("b").cast("double")).alias(name))


def groups(hist: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Masked counts ``a`` and unmasked counts ``b`` side by side."""
    return hist.groupBy(*by, "bin", "lo", "width").agg(F.sum(F.when(F.col("masked"), F.col("n")).otherwise(0)).cast("double").alias("a"), F.sum(F.when(F.col("masked"), 0).otherwise(F.col("n"))).cast("double").alias("b"))


def point_biserial(hist: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Correlation of brightness with being masked; null if a group is empty or all values are the same."""
    both = groups(hist, by).withColumn("c", centre())
    n1, n0 = F.sum("a"), F.sum("b")
    s1, s0 = F.sum(F.col("a") * F.col("c")), F.sum(F.col("b") * F.col("c"))
    sums = both.groupBy(*by).agg(n1.alias("n1"), n0.alias("n0"), s1.alias("s1"), s0.alias("s0"))
    spread = both.join(sums, list(by)).withColumn("m", (F.col("s1") + F.col("s0")) / (F.col("n1") + F.col("n0")))
    spread = spread.groupBy(*by, "n1", "n0", "s1", "s0").agg(F.sqrt(F.sum((F.col("a") + F.col("b")) * (F.col("c") - F.col("m")) ** 2) / (F.col("n1") + F.col("n0"))).alias("sd"))
    p1 = F.col("n1") / (F.col("n1") + F.col("n0"))
    r = F.try_divide(F.try_divide(F.col("s1"), F.col("n1")) - F.try_divide(F.col("s0"), F.col("n0")), F.col("sd")) * F.sqrt(p1 * (1 - p1))
    return spread.select(*by, r.alias("point_biserial_r"))


def _side_stats(hist: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """All statistics of both sides of each group, from one pass over its bins in order.

    Columns ``a`` are masked, ``b`` unmasked counts.  Every window has the same partitions, so one shuffle serves all.
    """
    whole = Window.partitionBy(*by)
    run = whole.orderBy("bin")
    x = groups(hist, by).withColumn("c", centre())
    x = x.withColumns({"a_upto": F.sum("a").over(run), "b_upto": F.sum("b").over(run), "a_all": F.sum("a").over(whole), "b_all": F.sum("b").over(whole)})

    def at(side: str, q: float) -> Column:
        inside = left_edge() + F.col("width") * (q * F.col(f"{side}_all") - (F.col(f"{side}_upto") - F.col(side))) / F.col(side)
        reached = (F.col(side) > 0) & (F.col(f"{side}_upto") >= q * F.col(f"{side}_all"))
        return F.min(F.when(reached, F.struct("bin", inside.alias("v"))))

    total = F.sum((F.col("a") + F.col("b")) * F.col("c")).over(whole)
    x = x.withColumns({"a_mid": at("a", 0.5).over(whole)["v"], "b_mid": at("b", 0.5).over(whole)["v"], "m": total / (F.col("a_all") + F.col("b_all"))})

    def up_to(point: str) -> Column:
        return F.least(F.greatest((F.col(point) - left_edge()) / F.col("width"), F.lit(0.0)), F.lit(1.0))

    a, b = F.sum("a"), F.sum("b")
    mean_a, mean_b = ratio(F.sum(F.col("a") * F.col("c")), a), ratio(F.sum(F.col("b") * F.col("c")), b)
    sd = F.sqrt(F.sum((F.col("a") + F.col("b")) * (F.col("c") - F.col("m")) ** 2) / (a + b))
    p = a / (a + b)
    below = F.col("b_upto") - F.col("b")
    return x.groupBy(*by).agg(
        (a + b).cast("long").alias("n_pixels"), a.cast("long").alias("n_masked"),
        mean_a.alias("mean_masked"), mean_b.alias("mean_unmasked"),
        F.max("a_mid").alias("median_masked"), F.max("b_mid").alias("median_unmasked"),
        at("a", 0.25)["v"].alias("p25_masked"), at("b", 0.25)["v"].alias("p25_unmasked"),
        at("a", 0.75)["v"].alias("p75_masked"), at("b", 0.75)["v"].alias("p75_unmasked"),
        ratio(a, a + b).alias("frac_masked"), F.try_divide(F.sum(F.col("a") * (below + 0.5 * F.col("b"))), a * b).alias("auc"),
        (F.try_divide(mean_a - mean_b, sd) * F.sqrt(p * (1 - p))).alias("point_biserial_r"),
        F.when(F.max("b_mid").isNotNull(), ratio(F.sum(F.col("a") * up_to("b_mid")), a)).alias("dim_masked_rate"),
        F.when(F.max("a_mid").isNotNull(), ratio(F.sum(F.col("b") * up_to("a_mid")), b)).alias("below_rate"),
    )


def group_stats(hist: DataFrame, by: tuple[str, ...] = KEYS) -> DataFrame:
    """All statistics of masked and unmasked brightness for each group of ``by``."""
    return _side_stats(hist, by).drop("dim_masked_rate", "below_rate")


def summarise_by_z(hist: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return group_stats(hist, (*keys, "z"))


def summarise_pooled(hist: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return group_stats(hist, keys)


def summarise_levels(hist: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """By plane and over all planes at once, with ``all_planes`` true and -1 as ``z``: the histogram is read once for both."""
    by_bin = (*keys, "masked", "bin", "lo", "width")
    both = hist.groupingSets([[*by_bin, "z"], [*by_bin]], *by_bin, "z").agg(F.sum("n").alias("n"), (F.grouping("z") == 1).alias("all_planes"))
    return group_stats(both.withColumn("z", F.coalesce("z", F.lit(-1))), (*keys, "z", "all_planes"))


def brightness_stats(hist: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The pooled statistics that are scored, with the overlap rates of both groups."""
    iqr = F.col("p75_unmasked") - F.col("p25_unmasked")
    shift = F.when(iqr > 0, (F.col("median_masked") - F.col("median_unmasked")) / iqr)
    return _side_stats(hist, keys).select(
        *keys, F.col("n_pixels").alias("n_voxels"), "n_masked", "frac_masked", F.col("auc").alias("separability"), "mean_masked", "mean_unmasked",
        "median_masked", "median_unmasked", shift.alias("median_shift_iqr"), "dim_masked_rate", (1.0 - F.col("below_rate")).alias("bright_unmasked_rate"), "point_biserial_r",
    )


def rebin(hist: DataFrame, edges: DataFrame, by: tuple[str, ...], on: tuple[str, ...], fold: bool = True) -> DataFrame:
    """Counts moved by their bin's centre to new edges (``new_lo``, ``new_width``, ``new_bins``), a row for each group of ``on``.

    What lies outside is folded into the end bins, or dropped.
    """
    joined = hist.join(edges, list(on)) if on else hist.crossJoin(F.broadcast(edges))  # one row
    to = F.floor((centre() - F.col("new_lo")) / F.col("new_width"))
    joined = joined.withColumn("to", to)
    if fold:
        joined = joined.withColumn("to", F.least(F.greatest("to", F.lit(0)), F.col("new_bins") - 1))
    else:
        last = centre() == F.col("new_lo") + F.col("new_width") * F.col("new_bins")
        joined = joined.withColumn("to", F.when(last, F.col("new_bins") - 1).otherwise(F.col("to")))
        joined = joined.where((F.col("to") >= 0) & (F.col("to") < F.col("new_bins")))
    return joined.groupBy(*by, F.col("to").cast("long").alias("bin"), F.col("new_lo").alias("lo"), F.col("new_width").alias("width")).agg(F.sum("n").alias("n"))


def display_edges(hist: DataFrame, by: tuple[str, ...], n_bins: int = DISPLAY_BINS, clip: float = CLIP_QUANTILE) -> DataFrame:
    """Edges from the first bin that holds anything to a high quantile."""
    total = hist.groupBy(*by, "bin", "lo", "width").agg(F.sum("n").alias("n"))
    ends = total.where("n > 0").groupBy(*by).agg(F.min(left_edge()).alias("new_lo")).join(quantiles(total, {"hi": clip}, by), list(by))
    hi = F.when(F.col("hi") > F.col("new_lo"), F.col("hi")).otherwise(F.col("new_lo") + 1)
    return ends.select(*by, "new_lo", ((hi - F.col("new_lo")) / n_bins).alias("new_width"), F.lit(n_bins).alias("new_bins"))


def display_bins(hist: DataFrame, by: tuple[str, ...] = KEYS, n_bins: int = 120, clip: float = CLIP_QUANTILE) -> DataFrame:
    """Both sides on even bins from the lowest edge to the centre of the bin that reaches the clip quantile; the rest is dropped."""
    flat = hist.groupBy(*by, "bin", "lo", "width").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by)
    run = flat.withColumn("share", F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w)).withColumn("c", centre())
    cut = F.coalesce(F.min(F.when(F.col("share") >= clip, F.col("c"))), F.max("c"))
    edges = run.groupBy(*by).agg(F.min("lo").alias("new_lo"), cut.alias("cut"))
    edges = edges.select(*by, "new_lo", ((F.col("cut") - F.col("new_lo")) / n_bins).alias("new_width"), F.lit(n_bins).alias("new_bins"))
    return rebin(hist, edges, (*by, "masked"), by, fold=False)


def overflow(hist: DataFrame, edges: DataFrame, by: tuple[str, ...], on: tuple[str, ...]) -> DataFrame:
    """How many of each group's counts lie beyond the last of the edges that ``display_edges`` gives."""
    past = left_edge() >= F.col("new_lo") + F.col("new_width") * F.col("new_bins")
    return hist.join(edges, list(on)).groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(past, F.col("n")).otherwise(0)).alias("n_over"))


def display_range(hist: DataFrame, by: tuple[str, ...], n_bins: int = DISPLAY_BINS, clip: float = CLIP_QUANTILE) -> DataFrame:
    """One common range over all groups: a single row."""
    own = display_edges(hist, by, n_bins, clip)
    ends = own.agg(F.min("new_lo").alias("new_lo"), F.max(F.col("new_lo") + F.col("new_width") * F.col("new_bins")).alias("hi"))
    return ends.select("new_lo", ((F.col("hi") - F.col("new_lo")) / n_bins).alias("new_width"), F.lit(n_bins).alias("new_bins"))


def pool_runs(hist: DataFrame, n_bins: int = FLOAT_BINS) -> DataFrame:
    """All fields on common edges, summed by technique and group."""
    ends = hist.agg(F.min(left_edge()).alias("new_lo"), F.max(left_edge() + F.col("width")).alias("hi"))
    edges = ends.select("new_lo", ((F.col("hi") - F.col("new_lo")) / n_bins).alias("new_width"), F.lit(n_bins).alias("new_bins"))
    return rebin(hist, edges, ("method", "masked"), ())


def distribution(hist: DataFrame, by: tuple[str, ...] = ("method", "masked")) -> DataFrame:
    """Share of each group's voxels by bin: what the brightness plots draw."""
    return hist.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*by))))


def overlap_thresholds(hist: DataFrame, quantile: float = OVERLAP_QUANTILE, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Quantiles ``masked_t`` and ``unmasked_t`` of every image that has voxels of both kinds."""
    t = quantiles(pooled(hist, keys), {"t": quantile}, (*keys, "masked"))
    t = t.groupBy(*keys).agg(F.max(F.when(F.col("masked"), F.col("t"))).alias("masked_t"), F.max(F.when(~F.col("masked"), F.col("t"))).alias("unmasked_t"))
    return t.where("masked_t is not null and unmasked_t is not null")


def overlap_layer() -> Column:
    """The layer of a voxel with ``masked``, ``brightness`` and the thresholds, or null."""
    bright = ~F.col("masked") & (F.col("brightness") >= F.col("masked_t"))
    return F.when(bright, "bright_unmasked").when(F.col("masked") & (F.col("brightness") <= F.col("unmasked_t")), "dim_masked")


def overlap_layers(voxels: DataFrame, hist: DataFrame, quantile: float = OVERLAP_QUANTILE, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Unmasked voxels at least as bright as the masked quantile, and masked ones at most as bright as the unmasked one."""
    v = vectorise_pixels(voxels).join(overlap_thresholds(hist, quantile, keys), list(keys))
    return v.withColumn("layer", overlap_layer()).where("layer is not null").select(*voxels.columns, "layer")
