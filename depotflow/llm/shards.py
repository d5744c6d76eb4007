"""Sharding by longest processing time: groups of rows, largest first, each go to the least-loaded shard of a heap.

A heap is sequential, so it must not see every group. Groups above a quantum (total bytes / `bundles`) are packed one by
one; there can't be more of them than `bundles`. All smaller groups fall by a hash of their text into `bundles` bundles, which are
packed like groups. The heap thus sees at most 2 * bundles items at any input size, and shards differ by about one bundle.
Small inputs have one group in a bundle, which is plain longest-processing-time scheduling.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from depotflow.llm.common import partitions

ROW_BYTES = 8  # what a row takes beside its text
BUNDLES = 24_576


def longest_first(items: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(kind, item, bytes) to (kind, item, shard): the largest item goes to the shard with the least load."""
    heap = [(0, s) for s in range(shards)]
    placed = []
    for kind, item, size in sorted(items, key=lambda x: (-x[2], x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed.append((kind, item, shard))
        heapq.heappush(heap, (load + size, shard))
    return placed


def assign_shards(
    docs: DataFrame, shards: int, text: str | Column = "text", order_by: tuple[str, ...] = ("doc_id",), bundles: int = BUNDLES
) -> DataFrame:
    """`docs` with size (bytes of the text plus 8), shard and slot (0, 1, .. in each shard, without gaps).

    Rows of equal text share a shard; null and empty texts are one group. Text hashes of 64 bits stand for the texts: a
    collision would only keep two groups together. Columns of `docs` named size, shard or slot are replaced. Rows that are
    equal in `order_by` and text are interchangeable. An empty table gives an empty result.
    """
    if shards < 1 or bundles < 1:
        raise ValueError("shards and bundles must be positive")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    keyed = docs.withColumns({"size": (F.octet_length(text) + ROW_BYTES).cast("long"), "_sh_text": F.xxhash64(text)})
    groups = keyed.groupBy("_sh_text").agg(F.sum("size").alias("bytes"))
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()["bytes"]
    large = F.col("bytes").cast("decimal(38,0)") * bundles > F.lit(total).cast("decimal(38,0)")
    bundle = F.pmod(F.col("_sh_text"), F.lit(bundles))
    items = (
        groups.select(large.cast("int").alias("kind"), F.when(large, F.col("_sh_text")).otherwise(bundle).alias("item"), "bytes")
        .groupBy("kind", "item")
        .agg(F.sum("bytes").alias("bytes"))
    )
    placed = longest_first([tuple(r) for r in items.collect()], shards)  # at most 2 * bundles rows
    schema = T.StructType([T.StructField(n, t) for n, t in (("_sh_at", T.LongType()), ("_sh_to", T.IntegerType()))])
    # both lists are bounded by `bundles`, so each executor can hold them
    alone, bundled = (spark.createDataFrame([x[1:] for x in placed if x[0] == kind], schema) for kind in (1, 0))
    chunks = partitions(spark)
    whole = F.struct(*[F.col(c) for c in order_by], F.col("_sh_text"))
    dealt = (
        keyed.join(F.broadcast(alone.select(F.col("_sh_at").alias("_sh_text"), F.col("_sh_to").alias("_sh_own"))), "_sh_text", "left")
        .withColumn("_sh_at", bundle)
        .join(F.broadcast(bundled), "_sh_at", "left")
        .withColumn("shard", F.coalesce("_sh_own", "_sh_to"))
        .withColumn("_sh_chunk", F.pmod(F.xxhash64(whole), F.lit(chunks)))
    )
    # slots: rows are numbered in chunks of a shard, and a chunk starts after the rows of those before it
    before = Window.partitionBy("shard").orderBy("_sh_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "_sh_chunk").agg(F.count("*").alias("_sh_rows"))  # shards * chunks rows
    starts = starts.select("shard", "_sh_chunk", F.coalesce(F.sum("_sh_rows").over(before), F.lit(0)).alias("_sh_start"))
    inside = F.row_number().over(Window.partitionBy("shard", "_sh_chunk").orderBy(*order_by, "_sh_text"))
    numbered = dealt.withColumn("_sh_row", inside).join(starts, ["shard", "_sh_chunk"])
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    return numbered.select(*kept, "size", "shard", (F.col("_sh_start") + F.col("_sh_row") - 1).alias("slot"))


def write_shards(sharded: DataFrame, folder: str) -> None:
    """One folder of Parquet files for each shard, rows in slot order within each file; refuses an existing folder."""
    ranges = partitions(sharded.sparkSession)
    sharded.repartitionByRange(ranges, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
