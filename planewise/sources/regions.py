"""Folders of segmentations and images measured where their blocks are read: what travels are counts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planewise.functions.columns import IMAGE, KEYS
from planewise.functions.storage import written
from planewise.operators import brightness as B
from planewise.operators import profile as P
from planewise.operators import scorecard as S
from planewise.sources import catalog as G
from planewise.sources.blocks import BLOCK_BYTES, Files, page_of, page_table
from planewise.sources.tiff import rows_of

#: Labels up to which a block's voxels are counted in a table of all of them, instead of by sorting.
TABLED = 1 << 22
_PAGES = ("height", "width", "kind", "packing", "predictor", "tiled", "across", "down", "offsets", "sizes")


def image_planes(spark: SparkSession, image_roots: Mapping[str, str], pattern: str) -> DataFrame:
    """``region``, ``fov``, ``path`` and ``z`` of all ``<root>/<fov>/<pattern>`` below each region's root.

    Planes stack in the order of the number after ``z`` in their names, whatever it begins with.
    """
    parts = []
    for region, root in image_roots.items():
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
        parts.append(files.select(F.lit(region).alias("region"), F.element_at(F.split("path", "/"), -2).alias("fov"), "path"))
    if not parts:
        raise ValueError("no image roots")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _stacked(out)


def image_files(spark: SparkSession, path: str, region: str = "", fov: str = "") -> DataFrame:
    """The same of one field, whose planes are the files that ``path`` matches."""
    files = spark.read.format("binaryFile").load(path)
    return _stacked(files.select(F.lit(region).alias("region"), F.lit(fov).alias("fov"), "path"))


def _stacked(files: DataFrame) -> DataFrame:
    order = Window.partitionBy(*IMAGE).orderBy(G.plane_number(F.col("path")), "path")
    return files.withColumn("z", F.row_number().over(order) - 1)


def page_struct(path: str = "path") -> F.Column:
    return F.struct(F.col(path).alias("path"), *_PAGES)


def slim_page(page: str, y: str, rows: str) -> F.Column:
    """A page with only the strips or tiles that some rows touch, beside the row at which those begin."""
    across, first, last = (f"cast(ceil({page}.width / {page}.across) as int)", f"cast(floor({y} / {page}.down) as int)", f"cast(ceil(least({page}.height, {y} + {rows}) / {page}.down) as int)")
    part = ", ".join(f"'{c}', slice({page}.{c}, {first} * {across} + 1, ({last} - {first}) * {across})" for c in ("offsets", "sizes"))
    rest = ", ".join(f"'{c}', {page}.{c}" for c in ("path", *_PAGES[1:8]))
    high = f"cast(least({page}.height, {last} * {page}.down) - {first} * {page}.down as int)"
    return F.expr(f"if({page} is null, null, named_struct('height', {high}, {rest}, {part}, 'skip', cast({y} - {first} * {page}.down as int)))")


def rows_of_block(page: str, target: int) -> F.Column:
    """Rows of a block: whole strips or rows of tiles of about ``target`` bytes of pixels, one at least."""
    return F.expr(f"cast(greatest(1, floor({target} / greatest(1, {page}.width * cast(substring({page}.kind, 3) as int) * {page}.down))) * {page}.down as int)")


def paired_blocks(masks: DataFrame, planes: DataFrame | None, target: int = BLOCK_BYTES) -> DataFrame:
    """``region``, ``fov``, ``z``, ``y``, ``rows``, ``image`` and ``masks`` of each block of rows of each plane.

    ``masks`` are files of ``catalog``, ``planes`` those of ``image_planes``.  A block has the same rows of the image's plane, read
    once, and of every technique's, however each file is cut: the rows are a multiple of the coarsest strips or tiles.  Volumes
    of one image that differ in shape, among each other or from the image, are an error; shapes come from the directories.
    """
    keys = (*IMAGE, "z")
    labels = page_table(masks.select(*KEYS, "path"))
    labels = labels.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("method", page_struct().alias("page")))).alias("masks"))
    if planes is None:
        table = labels.withColumn("image", F.expr("cast(null as struct<path string>)"))
    else:
        fields = page_table(planes.withColumnRenamed("z", "plane")).where("z = 0").drop("z").withColumnRenamed("plane", "z")
        table = labels.join(fields.select(*keys, page_struct().alias("image")), list(keys), "full")
    table = written(table)
    # every technique of an image has all its planes, in one shape
    methods = table.select(*IMAGE, F.explode("masks.method").alias("method")).distinct().groupBy(*IMAGE).agg(F.count("*").alias("n"))
    shape = "array_distinct(concat(transform(masks, m -> struct(m.page.height, m.page.width)), {}))"
    shape = shape.format("cast(array() as array<struct<height: int, width: int>>)" if planes is None else "array(struct(image.height, image.width))")
    wrong = table.join(methods, list(IMAGE)).where(f"masks is null or size(masks) <> n or size({shape}) <> 1")
    wrong = wrong.select(*keys).orderBy(*keys).take(3)  # for the message
    if wrong:
        raise ValueError(f"masks and image differ in shape: {', '.join('/'.join(map(str, r)) for r in wrong)}")
    wide = "transform(masks, m -> m.page.width * cast(substring(m.page.kind, 3) as int))[0]"
    down = "greatest(array_max(transform(masks, m -> m.page.down)), 1)" if planes is None else "greatest(array_max(transform(masks, m -> m.page.down)), image.down)"
    sized = table.where("masks is not null").withColumn("height", F.expr("masks[0].page.height"))
    sized = sized.withColumn("rows", F.expr(f"cast(greatest(1, floor({target} / greatest(1, {wide} * {down}))) * {down} as int)"))
    cut = sized.withColumn("y", F.explode(F.expr("sequence(0, greatest(height - 1, 0), rows)"))).withColumn("rows", F.expr("least(rows, height - y)"))
    image = slim_page("image", "y", "rows") if planes is not None else F.col("image")
    own = F.transform("masks", lambda m: F.struct(m["method"].alias("method"), m["page"].alias("page")))
    return cut.withColumn("image", image).withColumn("masks", own)


def block_pixels(files: Files, page: dict, y: int, rows: int) -> np.ndarray:
    """The rows of a block; a page that was cut down to them begins at ``skip``."""
    return rows_of(files.fetch(page["path"]), page_of(page), page.get("skip", y), rows)


def label_counts(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The labels of a block and how many voxels each has."""
    if pixels.dtype.kind in "ui" and pixels.size and 0 <= pixels.min() and pixels.max() < TABLED:
        counts = np.bincount(pixels.ravel())
        labels = np.flatnonzero(counts)
        return labels, counts[labels]
    labels, counts = np.unique(pixels, return_counts=True)
    return labels.astype(np.int64), counts


_PLANES = "region string, fov string, method string, label long, z int, area long, low double, high double, whole boolean"
_HIST = "region string, fov string, method string, z int, masked boolean, bin long, lo double, width double, exact boolean, n long"


def _measured(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Voxels of each label of each block, with the range of the image there."""
    files = Files()
    for part in parts:
        for r in part.to_pylist():
            low = high = whole = None
            if r["image"] is not None:
                light = block_pixels(files, r["image"], r["y"], r["rows"])
                low, high = (float(light.min()), float(light.max())) if light.size else (None, None)
                whole = bool(light.dtype.kind in "ui" or (light == np.floor(light)).all())
            for m in r["masks"]:
                labels, areas = label_counts(block_pixels(files, m["page"], r["y"], r["rows"]))
                n = len(labels)
                same = ((r["region"], pa.string()), (r["fov"], pa.string()), (m["method"], pa.string()))
                ends = ((low, pa.float64()), (high, pa.float64()), (whole, pa.bool_()))
                columns = [*(pa.array([v] * n, t) for v, t in same), pa.array(labels, pa.int64()), pa.array([r["z"]] * n, pa.int32()), pa.array(areas, pa.int64()), *(pa.array([v] * n, t) for v, t in ends)]
                yield pa.RecordBatch.from_arrays(columns, ["region", "fov", "method", "label", "z", "area", "low", "high", "whole"])
    files.close()


def _binned(light: np.ndarray, lo: float, width: float, n_bins: int, exact: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The bin of each pixel, and which pixels have one if not all do."""
    if exact and light.dtype.kind in "ui":
        return light.astype(np.int64) - int(lo + 0.5), None
    value = light.astype(np.float64)
    bins = np.minimum(np.floor((value - lo) / width), n_bins - 1)
    inside = (bins >= 0) & (value <= lo + width * n_bins)
    return np.where(inside, bins, 0).astype(np.int64), None if inside.all() else inside


def _histograms(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by bin of the masked and unmasked voxels of each block; labels in ``gone`` are background."""
    files = Files()
    names = ["region", "fov", "method", "z", "masked", "bin", "lo", "width", "exact", "n"]
    for part in parts:
        for r in part.to_pylist():
            bins, inside = _binned(block_pixels(files, r["image"], r["y"], r["rows"]), r["lo"], r["width"], r["n_bins"], r["exact"])
            gone = {g["method"]: g["labels"] for g in r["gone"] or []}
            for m in r["masks"]:
                pixels = block_pixels(files, m["page"], r["y"], r["rows"])
                masked = pixels > 0
                if gone.get(m["method"]):
                    masked &= ~np.isin(pixels, np.array(gone[m["method"]], np.int64))
                place = bins + np.int64(r["n_bins"]) * masked
                counts = np.bincount((place if inside is None else place[inside]).ravel())
                at = np.flatnonzero(counts)
                n = len(at)
                same = ((r["region"], pa.string()), (r["fov"], pa.string()), (m["method"], pa.string()), (r["z"], pa.int32()))
                edges = ((r["lo"], pa.float64()), (r["width"], pa.float64()), (r["exact"], pa.bool_()))
                columns = [*(pa.array([v] * n, t) for v, t in same), pa.array(at >= r["n_bins"]), pa.array(at % r["n_bins"]), *(pa.array([v] * n, t) for v, t in edges), pa.array(counts[at], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)
    files.close()


class BlockScan(S.Scan):
    """A ``Scan`` of files: blocks are read twice, each by the task that counts it, and no pixel is a row or is shuffled.

    ``planes`` gives for each label and plane the range of the image over the label's blocks, which adds up to the image's.
    """

    def __init__(self, masks: DataFrame, planes: DataFrame | None = None, target: int = BLOCK_BYTES, **how: object) -> None:
        super().__init__(masks, **how)
        self.blocks_of, self.target = planes, target

    @cached_property
    def blocks(self) -> DataFrame:
        """What each task reads: places in files, no pixels; dealt out evenly."""
        found = written(paired_blocks(self.voxels, self.blocks_of, self.target))
        return found.repartition(max(1, min(found.count(), 16 * found.sparkSession.sparkContext.defaultParallelism)))

    @cached_property
    def planes(self) -> DataFrame:
        ends = (F.min("low").alias("low"), F.max("high").alias("high"), F.bool_and("whole").alias("whole"))
        read = self.blocks.select(*IMAGE, "z", "y", "rows", "image", "masks").mapInArrow(_measured, _PLANES)
        return written(read.groupBy(*KEYS, "label", "z").agg(F.sum("area").alias("area"), *ends))

    @cached_property
    def segmentations(self) -> DataFrame:
        return self.planes.groupBy(*KEYS).agg(*B.ends("low", "high", "whole"))

    @cached_property
    def labels(self) -> DataFrame:
        return written(P.measured_labels(self.areas, self.area_floor, self.sliver_frac, self.keys))

    @cached_property
    def hist(self) -> DataFrame:
        if self.blocks_of is None:
            raise ValueError("brightness needs an image")
        # a label that the filter drops lies on one plane, so only that plane's blocks need to know it
        gone = self.dropped.join(self.labels.select(*KEYS, "label", F.col("z_start").alias("z")), [*KEYS, "label"])
        gone = gone.groupBy(*KEYS, "z").agg(F.collect_list("label").alias("labels")).groupBy(*IMAGE, "z").agg(F.collect_list(F.struct("method", "labels")).alias("gone"))
        found = self.blocks.join(self.edges, list(IMAGE)).join(gone, [*IMAGE, "z"], "left")
        found = found.select(*IMAGE, "z", "y", "rows", "image", "masks", "lo", "width", "n_bins", "exact", "gone")
        found = found.repartition(self.blocks.rdd.getNumPartitions())
        return written(found.mapInArrow(_histograms, _HIST).groupBy(*KEYS, "z", "masked", "bin", "lo", "width", "exact").agg(F.sum("n").alias("n")))


def scan_regions(spark: SparkSession, technique_roots: Mapping[str, str], image_roots: Mapping[str, str] | None = None, pattern: str = "DAPI_decon_z*.tif", regions: tuple[str, ...] | None = None, filename: str = "masks.tif", **how: object) -> BlockScan:
    """Every field that all techniques segmented, of the given regions or of those that all techniques have.

    ``image_roots`` has the folder of each region's images; without it there is no brightness.
    """
    found = G.find_region_fovs(G.catalog(spark, technique_roots, filename), len(technique_roots))
    wanted = found if regions is None else found.where(F.col("region").isin(*regions))
    wanted = written(wanted)
    if wanted.isEmpty():
        raise FileNotFoundError(f"{filename}: no field that all techniques segmented")
    planes = None
    if image_roots is not None:
        planes = image_planes(spark, image_roots, pattern).join(wanted.select(*IMAGE).distinct(), list(IMAGE), "left_semi")
    return BlockScan(wanted, planes, **how)


def score_folders(spark: SparkSession, technique_roots: Mapping[str, str], image_roots: Mapping[str, str] | None = None, weights: Mapping[str, float] | None = None, **how: object) -> DataFrame:
    """From folders to the scorecard of every field and technique."""
    s = scan_regions(spark, technique_roots, image_roots, **how)
    return S.score_fovs(S.fov_metrics(s.measures, None if image_roots is None else s.brightness, s.filters), weights)
