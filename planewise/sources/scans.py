"""Scans of whole folders of segmentations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewise.functions.storage import written
from planewise.operators.areas import span_table
from planewise.operators.summaries import volume_summary
from planewise.sources.blocks import BLOCK_BYTES, Files, page_table
from planewise.sources.regions import block_pixels, label_counts, page_struct, rows_of_block, slim_page


@dataclass(frozen=True)
class ScanResult:
    """A row for each volume, a row for each label, and the files that could not be read with the reason."""

    summary: DataFrame
    labels: DataFrame
    failures: DataFrame


_COUNTED = pa.schema([("path", pa.string()), ("z", pa.int32()), ("label", pa.int64()), ("area", pa.int64()), ("error", pa.string())])


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Voxels of every label in every block, or why a block could not be read."""
    files = Files()
    for part in parts:
        for r in part.to_pylist():
            try:
                labels, areas = label_counts(block_pixels(files, r["page"], r["y"], r["rows"]))
                columns = [[r["path"]] * len(labels), [r["z"]] * len(labels), labels.astype(np.int64), areas.astype(np.int64), [None] * len(labels)]
            except Exception as e:  # whatever is wrong with a file, the others go on
                columns = [[r["path"]], [None], [None], [None], [f"{type(e).__name__}: {e}"]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTED, strict=True)], schema=_COUNTED)
    files.close()


def scan_segmentations(spark: SparkSession, root: str, pattern: str = "masks.tif", level_names: tuple[str, ...] = (), target_bytes: int = BLOCK_BYTES) -> ScanResult:
    """Measure all volumes named ``pattern`` below ``root``.

    Directories below the root become columns: the names belong to the innermost ones, those above are ``level_0`` and so
    on.  ``relpath`` is the path below the root.  Volumes without labels have zero counts; a file that cannot be read, in whole or in part, is a row
    of ``failures`` and nothing else.  Blocks of about ``target_bytes`` are counted where they are read, so only areas travel.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    pages = written(page_table(files.select("path"), errors=True))
    found = pages.where("error is null").select("path", "z", page_struct().alias("page"))
    found = found.withColumn("rows", rows_of_block("page", target_bytes))
    found = found.withColumn("y", F.explode(F.expr("sequence(0, greatest(page.height - 1, 0), rows)"))).withColumn("rows", F.expr("least(rows, page.height - y)"))
    found = written(found.withColumn("page", slim_page("page", "y", "rows")))
    spread = found.repartition(max(1, min(found.count(), 16 * spark.sparkContext.defaultParallelism)))
    read = written(spread.select("path", "z", "y", "rows", "page").mapInArrow(_counted, "path string, z int, label long, area long, error string"))
    areas = read.where("error is null").groupBy("path", "z", "label").agg(F.sum("area").alias("area"), F.lit(None).cast("string").alias("error"))
    failed = pages.where("error is not null").select("path", "error").unionByName(read.where("error is not null").select("path", "error"))
    failed = failed.groupBy("path").agg(F.min("error").alias("error"))
    failed = failed.select("path", F.lit(None).cast("int").alias("z"), F.lit(None).cast("long").alias("label"), F.lit(None).cast("long").alias("area"), "error")
    counted = areas.join(failed.select("path"), "path", "left_anti").unionByName(failed)
    inside = F.substring_index("path", f"{root.split(':', 1)[-1].rstrip('/')}/", -1)
    counted = written(counted.withColumn("relpath", inside))
    levels = F.split("relpath", "/")
    depth = counted.agg(F.max(F.size(levels))).first()[0]
    if depth is None:
        raise FileNotFoundError(f"{root}/**/{pattern}")
    free = max(0, depth - 1 - len(level_names))
    names = [*(f"level_{k}" for k in range(free)), *level_names[max(0, len(level_names) - depth + 1) :]]
    columns = [F.try_element_at(levels, F.lit(k - len(names) - 1)).alias(name) for k, name in enumerate(names)]
    volumes = counted.where("error is null").select("path", "relpath", *columns).distinct()
    areas = counted.where("label > 0").select("path", "label", "z", "area")
    labels = span_table(areas, ("path",)).withColumn("spans_multiple_layers", F.col("z_span") > 1)
    summary = volumes.join(volume_summary(labels, ("path",)), "path", "left").fillna(0, ["n_labels", "n_with_z_gaps"])
    labels = volumes.join(labels.select("path", "label", "z_start", "z_end", "z_span", "n_planes", "n_voxels", "spans_multiple_layers"), "path")
    return ScanResult(summary, labels, counted.where("error is not null").select("path", "relpath", "error"))
