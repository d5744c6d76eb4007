from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from depotflow import session
from depotflow.session import RUNTIME_SETTINGS, shared_folder, stage, stage_result, unstage


def test_a_task_reads_a_bounded_part_of_a_larger_shuffle(spark):
    """About 100 MB of shuffled rows, coalesced by size alone, take several tasks; what a task sorts does not grow with the table."""
    before = {k: spark.conf.get(k, None) for k in (*RUNTIME_SETTINGS, "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    try:
        for key, value in (RUNTIME_SETTINGS | {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}).items():
            spark.conf.set(key, value)
        # random bytes, which no codec makes smaller
        rows = spark.range(0, 500_000, 1, 4).select("id", *[F.unhex(F.sha2(F.concat_ws("-", "id", F.lit(k)), 512)).alias(f"b{k}") for k in range(3)])
        shuffled = rows.repartition("id")
        assert shuffled.rdd.getNumPartitions() >= 5
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def staged(spark):
    return {n for n in os.listdir(shared_folder(spark).removeprefix("file:")) if n.startswith("stage-")}


def test_what_is_staged_on_the_way_goes_with_the_result(spark):
    before = staged(spark)

    def doubled():
        rows = stage(spark.range(10))
        return stage_result(lambda: stage(rows).unionAll(rows)).unionAll(rows)

    result = stage_result(doubled)
    assert len(staged(spark) - before) == 1 and result.count() == 30
    unstage(result)
    assert staged(spark) == before and session._within == []


def test_staging_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {name for name in disk.getAllBlocks().mkString(",").split(",") if name.startswith("shuffle_")}
    before, setting = files(), spark.conf.get(session.FREE_SHUFFLES, None)
    out = stage(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count())
    until = time.time() + 30
    while files() - before and time.time() < until:  # Spark removes them without waiting
        time.sleep(0.1)
    assert not files() - before and out.count() == 1000 and spark.conf.get(session.FREE_SHUFFLES, None) == setting
