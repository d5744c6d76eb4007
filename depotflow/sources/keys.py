"""Loads by key that read little of their target: the table lies in hash buckets of its key, behind a filter of the keys it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from depotflow.operators.bitmaps import BUCKET_BITS, has_bit
from depotflow.operators.joins import first_per_key, unknown
from depotflow.session import stage
from depotflow.sources.tables import TableStore

BUCKET = "key_bucket"  # the partition column


class KeyedTable:
    """A table that takes rows with new keys only.

    `buckets` are partitions by hash of the key. The filter has `filter_rows` bitmaps of 32,768 bits, stored beside the table and joined by their
    number; it never clears a key that the table holds. With 16 bits for each expected key, one new key in sixteen has to be looked up; a
    filter too small for its table costs reads, never rows. Both sizes belong to the stored table and must stay as they are.
    """

    def __init__(self, store: TableStore, table: str, key: str, ddl: str, buckets: int = 64, filter_rows: int = 64):
        self.store, self.table, self.key, self.ddl = store, table, key, ddl
        self.buckets, self.filter_rows = buckets, filter_rows

    @property
    def _filter(self) -> str:
        return f"{self.table}_key_filter"

    def read(self) -> DataFrame:
        return self.store.read(self.table, f"{self.ddl}, {BUCKET} int").drop(BUCKET)

    def _bit(self) -> Column:
        return F.pmod(F.xxhash64(F.lit("filter"), self.key), F.lit(self.filter_rows * BUCKET_BITS))

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumns({BUCKET: F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"), "_bit": self._bit()})

    def _flagged(self, placed: DataFrame) -> DataFrame:
        """Add whether the filter lets a key through, i.e. whether the table may hold it."""
        stored = self.store.read(self._filter, "_number bigint, _bits binary")
        bits = stored.groupBy("_number").agg(F.bitmap_or_agg("_bits").alias("_bits"))
        joined = placed.join(bits, F.floor(F.col("_bit") / BUCKET_BITS) == F.col("_number"), "left")
        return joined.withColumn("_may", has_bit(F.col("_bits"), F.col("_bit") % BUCKET_BITS)).drop("_number", "_bits")

    def lookup(self, buckets: list[int]) -> DataFrame:
        """Keys the table holds in some buckets; no other partition is read."""
        return self.store.read(self.table, f"{self.ddl}, {BUCKET} int").filter(F.col(BUCKET).isin(buckets)).select(self.key)

    def add(self, batch: DataFrame, tie_break: list[str]) -> dict[str, int]:
        """Append rows whose key the table lacks, one for each key; returns the rows added and the buckets looked up.

        A row without a key counts as new each time it comes, but once in a batch. The filter is written before the rows: a load that breaks off
        between the two leaves keys in the filter that the table lacks, which the next load looks up and finds missing.
        """
        flagged = stage(self._flagged(self._placed(first_per_key(batch, [self.key], tie_break))))
        asked = [r[BUCKET] for r in flagged.filter("_may").select(BUCKET).distinct().collect()]  # no more than there are buckets
        new = flagged.filter("not _may")
        if asked:
            new = new.unionAll(unknown(flagged.filter("_may"), self.lookup(asked), self.key).select(*flagged.columns))
        new = stage(new)
        rows = new.count()
        if rows:
            number = F.floor(F.col("_bit") / BUCKET_BITS).alias("_number")
            bits = new.groupBy(number).agg(F.bitmap_construct_agg(F.col("_bit") % BUCKET_BITS).alias("_bits"))
            self.store.append(self._filter, bits)
            self.store.append(self.table, new.drop("_bit", "_may").hint("rebalance", BUCKET), [BUCKET])
        return {"rows": rows, "buckets": len(asked)}
