"""Profiles over a stream of blocks against the same of the whole table."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from planewise.operators import profile as P
from planewise.streaming.volumes import complete_volumes, profile_stream
from tests.test_regions import rows

SCHEMA = "region string, fov string, method string, label long, z long, area long, n_voxels long, ts timestamp"


def blocks(seed=0):
    """Counts of three volumes of 6 planes in 2 blocks each, every block with some background, in shuffled order."""
    rng = random.Random(seed)
    out = []
    for fov in ("f1", "f2", "f3"):
        counts = [[(label, z, rng.randrange(1, 60)) for label in (0, *rng.sample(range(1, 9), 6))] for z in range(6) for _ in range(2)]
        total = sum(n for b in counts for _, _, n in b)
        out += [[("r", fov, "m", label, z, n, total, f"2024-01-01 00:{rng.randrange(60):02}:00") for label, z, n in b] for b in counts]
    rng.shuffle(out)
    return out


def frame(spark, data):
    return spark.createDataFrame([r for b in data for r in b], SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))


def run(spark, query_of, data, path, size=5):
    """Feed the blocks as files, some at a time."""
    for k in range(0, len(data), size):
        frame(spark, data[k : k + size]).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    query = query_of(stream).option("checkpointLocation", f"{path}/state").start()
    query.processAllAvailable()
    query.stop()


def test_stream_of_blocks_equals_the_table(spark, tmp_path):
    data = blocks()
    got, batches = [], set()

    def give(df, number):
        found = rows(df)
        got.extend(found)
        if found:
            batches.add(number)

    run(spark, lambda s: profile_stream(s, give, area_floor=5), data, tmp_path)
    whole = frame(spark, data).groupBy("region", "fov", "method", "label", "z").agg(F.sum("area").alias("area"))
    assert sorted(got, key=repr) == rows(P.profiles(whole.where("label > 0"), 5))
    assert len(batches) > 1  # volumes are given out as they are complete


def test_volumes_that_never_end(spark, tmp_path):
    """A block is missing: the volume is given out when time has passed, and what comes later is left out."""
    data = [b for b in blocks(1) if b[0][1] == "f1"]
    missing = [[(*r[:7], "2024-01-09 00:00:00") for r in data[-1]]]
    other = [[("r", "late", "m", 0, 0, 1, 9, f"2024-01-0{d} 00:00:00")] for d in (5, 6, 7)]
    seen = []

    def give(df, _):
        seen.extend(df.collect())

    run(spark, lambda s: complete_volumes(s).writeStream.foreachBatch(give), [*data[:-1], *other, *missing], tmp_path, 1)
    f1 = [r for r in seen if r.fov == "f1"]
    assert f1 and not any(r.complete for r in f1)
    assert sum(r.area for r in f1) == sum(r[5] for b in data[:-1] for r in b)
