"""Helpers shared by the corpus operators: reading, checkpoints and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder, by Spark's own reader (the path may name any store)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, which all executors share: the one that ``spark.checkpoint.dir`` names.

    A session on one machine that has none, as in tests, gets a temporary folder; a cluster's must name one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of one key that a task takes in a join; keys with more are dealt to ``SALTS`` tasks.
HEAVY, SALTS = 100_000, 64


def split_join(left: DataFrame, right: DataFrame, on: list[str] | str, weight: str, heavy: int = HEAVY) -> DataFrame:
    """``left`` joined with ``right``, which has a row for each key ``on`` and, as ``weight``, the key's rows in ``left``.

    The rows of a key with more than ``heavy`` rows are dealt by their content to ``SALTS`` tasks, to each of which the
    key's row of ``right`` goes.  There are fewer such keys than one for every ``heavy`` rows of ``left``, so they
    are broadcast.  Without them this is an ordinary equality join.
    """
    on = [on] if isinstance(on, str) else on
    crowded = F.broadcast(right.where(F.col(weight) > heavy).select(*on, F.lit(True).alias("_crowded")))
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))
    dealt = left.join(crowded, on, "left").withColumn("_salt", F.when(F.col("_crowded"), spread).otherwise(F.lit(0)).cast("int"))
    salts = F.when(F.col(weight) > heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = right.withColumn("_salt", F.explode(salts)).drop(weight)
    return dealt.join(copies, [*on, "_salt"]).drop("_salt", "_crowded")


def components(edges: DataFrame, max_rounds: int = 60, heavy: int = HEAVY) -> DataFrame:
    """Smallest reachable id of every node that has an edge: columns ``node`` and ``root``.

    ``edges`` has long columns ``u`` and ``v``, in either direction and with repeats.  Alternating large-star and
    small-star steps (Kiveris et al., 2014) turn every component into a star around its smallest id.  Each step
    is a grouped minimum, which is combined before the shuffle, and an equality join that deals the edges of a
    node with more than ``heavy`` of them to many tasks.  The edges are checkpointed after each round; only their
    count and a checksum reach the driver.
    """
    current = checkpoint(_down(edges))
    before = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = split_join(both, least, "u", "n", heavy=heavy).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpoint(_down(large))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = split_join(large, least, "u", "n", heavy=heavy).select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = checkpoint(_down(small.unionByName(least.select("u", F.col("m").alias("v")))))
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end; loops go."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the application ends."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Takes less room than ``checkpoint``.  The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Tasks of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
