"""Session settings and the shared folder that staged data goes to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on. The join strategy is left to the optimizer: it broadcasts a side only
# when its measured size is under spark.sql.autoBroadcastJoinThreshold and otherwise shuffles, splitting hot keys.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a task sorts what it reads, unpacked, in memory: its memory follows this size, and larger tables get more tasks
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "600",
    # parts that small are joined by hash; sorting both sides by ids that begin alike costs more
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16m",
    "spark.sql.files.maxPartitionBytes": "32m",
    # compressed columnar files understate what a broadcast of their rows would take
    "spark.sql.sources.fileCompressionFactor": "3.0",
}
# Spark's own switch: shuffle files go when their query ends, and not only when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Folders staged within each `stage_result` that is under way, the innermost last.
_within: list[list[str]] = []


def build_session(app: str = "depotflow", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the runtime settings above; extra settings use '__' for '.' in their names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session someone else made."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, from spark.checkpoint.dir; a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back; the shuffle files of the write go with its end.

    Later branches then see identical rows whatever happens to an executor, read only the columns they need, and
    the optimizer knows the real size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.parquet(path)
    if _within:
        _within[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_result(make: Callable[[], DataFrame]) -> DataFrame:
    """`stage(make())`, then delete what `make` staged on the way: no other frame may read that."""
    _within.append([])
    try:
        result = make()
    finally:
        made = _within.pop()
    staged = stage(result)
    for path in made:
        _delete(result.sparkSession, path)
    return staged


def unstage(staged: DataFrame) -> None:
    """Delete what `stage` wrote for this frame; neither it nor a frame built on it can be read any more."""
    for folder in {file.rsplit("/", 1)[0] for file in staged.inputFiles()}:
        _delete(staged.sparkSession, folder)


def drop_staged(spark: SparkSession) -> None:
    """Delete what this application staged; frames built on it can no longer be read."""
    _delete(spark, f"{shared_folder(spark)}/stage-*")


def _delete(spark: SparkSession, pattern: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(path) or []:  # null for a folder that is gone
        fs.delete(status.getPath(), True)
