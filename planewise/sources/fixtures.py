"""Voxel views over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Brightness columns: whole numbers, or nearly unique decimals.
BRIGHTNESS = {"int": "cast(l_quantity as int)", "float": "l_extendedprice"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def voxels(spark: SparkSession, sf_dir: str, label: str = "l_suppkey", brightness: str = "int") -> DataFrame:
    """Line items as voxels: region and nation of the supplier, line status as technique, quarters as planes.

    Rows with return flag N are background.  The dimension tables are small next to the items, so adaptive
    planning broadcasts them where their size allows.
    """
    items = read(spark, sf_dir, "lineitem")
    supplier, nation, region = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("r_name").alias("region"),
        F.col("n_name").alias("fov"),
        F.col("l_linestatus").alias("method"),
        F.expr("cast((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 as int)").alias("z"),
        F.col("l_orderkey").cast("int").alias("y"),
        F.col("l_linenumber").cast("int").alias("x"),
        F.expr(f"cast(case when l_returnflag = 'N' then 0 else {label} end as bigint)").alias("label"),
        F.expr(f"cast({BRIGHTNESS[brightness]} as double)").alias("brightness"),
    )


def voxels_sql(label: str = "l_suppkey", brightness: str = "int") -> str:
    """The same view as a common table expression ``vox``."""
    return f"""vox as (select r_name as region, n_name as fov, l_linestatus as method,
  cast((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 as int) as z, cast(l_orderkey as int) as y, cast(l_linenumber as int) as x,
  cast(case when l_returnflag = 'N' then 0 else {label} end as bigint) as label, cast({BRIGHTNESS[brightness]} as double) as brightness
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
