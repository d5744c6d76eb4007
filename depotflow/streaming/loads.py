"""availableNow jobs: new files in a landing folder are loaded once, each micro-batch through the batch operators."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from depotflow.operators.joins import first_per_key
from depotflow.operators.versions import after_watermark, not_yet_loaded, watermark
from depotflow.sources.keys import KeyedTable
from depotflow.sources.tables import TableStore


def drain(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    load: Callable[[DataFrame, int], None],
    progress: str,
    file_filter: str = "*.parquet",
    files_per_batch: int = 1000,
) -> None:
    """Run `load` on every micro-batch of files not seen before; `progress` keeps the stream's position."""
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", file_filter)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )
    query = (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def load_by_key(store: TableStore, table: str, key: str, tie_break: list[str], ddl: str) -> Callable[[DataFrame, int], None]:
    """Append rows with keys the table lacks. A repeated micro-batch finds its keys loaded and adds nothing."""

    def load(batch: DataFrame, _: int) -> None:
        fresh = first_per_key(batch, [key], tie_break)
        store.append(table, not_yet_loaded(fresh, store.read(table, ddl), key))

    return load


def load_by_bucketed_key(table: KeyedTable, tie_break: list[str]) -> Callable[[DataFrame, int], None]:
    """Like `load_by_key` into a keyed table, of which a batch reads only the buckets that may hold one of its keys."""

    def load(batch: DataFrame, _: int) -> None:
        table.add(batch, tie_break)

    return load


def load_by_date(
    store: TableStore, table: str, day: str, delivery: str, floor: date, cutoff: date, ddl: str
) -> Callable[[DataFrame, int], None]:
    """Append rows after the largest date that earlier deliveries loaded, up to the cutoff; late rows are not loaded.

    The mark leaves out rows of this delivery, so it is the same for all its micro-batches and after a restart. Each
    micro-batch owns one partition (delivery, batch); repeating it replaces that partition.
    """
    layout = f"{ddl}, delivery string, batch bigint"
    earlier = store.read(table, layout).filter(F.col("delivery") != delivery)
    mark = watermark(earlier.select(day), day, floor)

    def load(batch: DataFrame, batch_id: int) -> None:
        fresh = after_watermark(batch, day, mark, cutoff)
        store.put(table, fresh.withColumns({"delivery": F.lit(delivery), "batch": F.lit(batch_id)}), ["delivery", "batch"])

    return load
