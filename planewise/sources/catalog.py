"""Which segmentations exist: rows ``region``, ``fov``, ``method``, ``method_ord`` and ``path``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def catalog(spark: SparkSession, technique_roots: Mapping[str, str], filename: str = "masks.tif") -> DataFrame:
    """All ``<root>/<region>/<fov>/<filename>`` below each technique's root; the mapping's order numbers the techniques."""
    parts = []
    for order, (method, root) in enumerate(technique_roots.items()):
        files = spark.read.format("binaryFile").option("pathGlobFilter", filename).option("recursiveFileLookup", "true").load(root)
        levels = F.split("path", "/")
        parts.append(files.select(F.element_at(levels, -3).alias("region"), F.element_at(levels, -2).alias("fov"), F.lit(method).alias("method"), F.lit(order).alias("method_ord"), "path"))
    if not parts:
        raise ValueError("no technique roots")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def available_regions(found: DataFrame, n_methods: int) -> DataFrame:
    """Regions that every technique has."""
    return found.groupBy("region").agg(F.countDistinct("method").alias("n")).where(F.col("n") == n_methods).select("region")


def find_region_fovs(found: DataFrame, n_methods: int, paired_only: bool = True) -> DataFrame:
    """Segmentations of the fields that every technique has, by field and then in the techniques' order."""
    if paired_only:
        paired = found.groupBy("region", "fov").agg(F.countDistinct("method").alias("n")).where(F.col("n") == n_methods)
        found = found.join(paired.select("region", "fov"), ["region", "fov"], "left_semi")
    return found.orderBy("region", "fov", "method_ord")


def fov_glob(root: str, fov: F.Column, pattern: str) -> F.Column:
    """Where a field's intensity planes are."""
    return F.concat_ws("/", F.lit(root), fov, F.lit(pattern))


def plane_number(path: F.Column) -> F.Column:
    """The number after ``z`` in a file name, 0 if it has none; planes stack in its order."""
    digits = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"z(\d+)", 1)
    return F.when(digits == "", F.lit(0)).otherwise(digits.cast("int"))


def variant(*levels: str, separator: str = "/") -> F.Column:
    """Levels joined to one column ``variant``."""
    return F.concat_ws(separator, *levels).alias("variant")
