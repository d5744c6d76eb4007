"""Parquet tables: full refresh as a new version, append into the current one.

A version is a folder that Spark writes in one job and marks with _SUCCESS when complete; readers take the newest
complete version, so a failed or running refresh never shows and no path is overwritten while it is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from depotflow import schemas


@dataclass(frozen=True)
class LoadResult:
    table: str
    rows_source: int
    rows_loaded: int
    status: str
    message: str = ""


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, table: str) -> list[int]:
        jvm = self.spark._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/version=*/_SUCCESS")
        fs = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.globStatus(pattern) or []
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)

    def exists(self, table: str) -> bool:
        return bool(self._versions(table))

    def path(self, table: str) -> str:
        return f"{self.root}/{table}/version={self._versions(table)[-1]}"

    def read(self, table: str, schema: str | StructType | None = None) -> DataFrame:
        """Newest complete version; with a schema, a table never written reads as empty instead of failing."""
        if self.exists(table):
            reader = self.spark.read if schema is None else self.spark.read.schema(schema)
            return reader.parquet(self.path(table))
        if schema is None:
            raise LookupError(f"table {table} has no complete version under {self.root}")
        return self.spark.createDataFrame([], schema)

    def refresh(self, table: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Write a new version and return it."""
        version = max(self._versions(table), default=0) + 1
        # an aborted attempt may have left files without _SUCCESS under this number
        df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(f"{self.root}/{table}/version={version}")
        return self.read(table, df.schema if partition_by else None)  # without rows there are no partitions to tell the schema

    def append(self, table: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        """Add rows to the current version (or start the first one)."""
        if not self.exists(table):
            self.refresh(table, df, partition_by)
            return
        df.write.mode("append").partitionBy(*(partition_by or [])).parquet(self.path(table))

    def put(self, table: str, df: DataFrame, partition_by: list[str]) -> None:
        """Replace exactly the partitions `df` has rows for; doing it twice changes nothing."""
        if not self.exists(table):
            self.refresh(table, df, partition_by)
            return
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*partition_by).parquet(self.path(table))


def aligned(df: DataFrame, table: str) -> DataFrame:
    """Columns the target knows, by name, in target order, with target types."""
    fields = [f for f in schemas.schema(table).fields if f.name in df.columns]
    return df.select(*[F.col(f.name).cast(f.dataType) for f in fields])


def full_refresh(store: TableStore, table: str, df: DataFrame, partition_by: list[str] | None = None) -> LoadResult:
    """Replace the table and compare the rows written with the rows found."""
    seen = Observation(f"load_{table}")
    try:
        source = aligned(df, table).observe(seen, F.count(F.lit(1)).alias("rows"))
        loaded = store.refresh(table, source, partition_by).count()
    except Exception as error:  # noqa: BLE001 - the status row is the contract of a load
        return LoadResult(table, 0, 0, "ERROR", str(error).split("\n")[0])
    rows = int(seen.get["rows"])
    return LoadResult(table, rows, loaded, "OK" if rows == loaded else "ROW_COUNT_MISMATCH")


def load_routed(
    store: TableStore, table: str, routed: DataFrame, key: str, accepted: str, rejected: str, stamp: Callable[[DataFrame], DataFrame] = lambda df: df
) -> dict[str, int]:
    """Write rows with a verdict once, as partitions by verdict; append the accepted ones to the table and the rejected ones, unless
    they are there, to `quarantine_<table>`. Returns the rows of each verdict, counted by the write itself.
    """
    seen = Observation(f"route_{table}")
    observed = routed.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("verdict") == v).alias(v) for v in (accepted, rejected)])
    latest = store.refresh(f"routed_{table}", observed, ["verdict"])
    found = {k: int(v) for k, v in seen.get.items()}
    if found[accepted]:
        store.append(table, stamp(latest.filter(F.col("verdict") == accepted).drop("verdict")))
    if found[rejected]:
        held = store.read(f"quarantine_{table}", latest.schema).select(F.col(key).alias("_held"))
        fresh = latest.filter(F.col("verdict") == rejected)
        store.append(f"quarantine_{table}", fresh.join(held, F.col(key) == F.col("_held"), "left_anti"))
    return found


# Load order, dimensions before facts.
STAR_LOAD_ORDER = (
    "dim_date", "dim_warehouse", "dim_supplier", "dim_sku", "fact_daily_demand", "fact_inventory_snapshot",
)


def load_star(store: TableStore, frames: dict[str, DataFrame]) -> list[LoadResult]:
    return [full_refresh(store, name, frames[name]) for name in STAR_LOAD_ORDER if name in frames]


def publish_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def log_steps(store: TableStore, steps: list[tuple[str, str, int, float, str]], run_at: Column, run_id: int, log: str = "run_log") -> None:
    """Append one row per step (step, status, rows, seconds, notes) of a run to a log."""
    spark = store.spark
    rows = spark.createDataFrame(steps, "step string, status string, rows_processed bigint, duration_s double, notes string")
    store.append(log, rows.withColumns({"run_at": run_at, "run_id": F.lit(run_id).cast("bigint")}).coalesce(1))
