"""Keyed tables: new keys only, and few buckets read."""

import pytest
from pyspark.sql import functions as F

from depotflow.sources.keys import BUCKET, KeyedTable
from depotflow.sources.tables import TableStore

DDL = "id string, v int"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(TableStore(spark, str(tmp_path)), "t", "id", DDL)


def ids(spark, first, last):
    return spark.range(first, last).select(F.concat(F.lit("k"), "id").alias("id"), F.col("id").cast("int").alias("v"))


def test_an_increment_reads_few_buckets(spark, table):
    assert table.add(ids(spark, 0, 20_000), ["v"]) == {"rows": 20_000, "buckets": 0}
    new = table.add(ids(spark, 20_000, 20_200), ["v"])  # all new: only keys that the filter can't clear are looked up
    assert new["rows"] == 200 and new["buckets"] <= 12
    again = table.add(ids(spark, 20_199, 20_201), ["v"])  # one known, one new
    assert again["rows"] == 1 and 1 <= again["buckets"] <= 2
    assert table.read().count() == table.read().select("id").distinct().count() == 20_201


def test_a_lookup_reads_its_partitions_only(spark, table):
    table.add(ids(spark, 0, 5_000), ["v"])
    found = table.lookup([3, 5])
    files = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
    assert files and all(f"{BUCKET}=3/" in f or f"{BUCKET}=5/" in f for f in files)
    plan = found._jdf.queryExecution().executedPlan().toString()  # the partitions are cut before any file is opened
    assert "PartitionFilters: [key_bucket" in plan or "PartitionFilters: [isnotnull(key_bucket" in plan
    assert "ReadSchema: struct<id:string>" in plan


def test_repeated_and_missing_keys(frame, table):
    batch = frame(DDL, [("a", 2), ("a", 1), ("b", None), (None, 7), (None, 8)])
    assert table.add(batch, ["v"])["rows"] == 3
    assert table.add(batch, ["v"])["rows"] == 1  # the row without a key
    got = sorted(map(tuple, table.read().collect()), key=repr)
    assert got == sorted([("a", 1), ("b", None), (None, 7), (None, 7)], key=repr)
    assert table.add(batch.limit(0), ["v"]) == {"rows": 0, "buckets": 0}


def test_a_load_that_broke_off_after_the_filter(spark, table, monkeypatch):
    append = TableStore.append

    def broken(self, name, *rest):
        if name == "t":
            raise OSError("lost")
        append(self, name, *rest)

    monkeypatch.setattr(TableStore, "append", broken)
    with pytest.raises(OSError):
        table.add(ids(spark, 0, 50), ["v"])
    monkeypatch.setattr(TableStore, "append", append)
    assert table.add(ids(spark, 0, 50), ["v"])["rows"] == 50 and table.read().count() == 50


def test_a_full_filter_loses_nothing(spark, tmp_path):
    small = KeyedTable(TableStore(spark, str(tmp_path)), "t", "id", DDL, buckets=4, filter_rows=1)
    small.add(ids(spark, 0, 100_000), ["v"])
    assert small.add(ids(spark, 99_990, 100_010), ["v"])["rows"] == 10 and small.read().count() == 100_010
