"""Small intermediate tables, written once and read where they are needed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the session's checkpoint folder, which all executors share, and read it back.

    For aggregates that several results are derived from: their input is read once, and a lost executor costs
    nothing.  The files go when the application ends.  A session on one machine without a folder gets a temporary one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    path = f"{context.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
