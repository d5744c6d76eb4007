"""Bitmap states against sets of Python numbers."""

import random

import pytest

from depotflow.operators.bitmaps import (
    distinct_keys, has_bit, key_state, merge_states, might_hold, only, repeated_keys, with_membership, without,
)
from pyspark.sql import functions as F

KEYS = {
    "dense": list(range(1, 200)),
    "repeated": [1, 1, 2, 32768, 32768, 32769, 70_000, 70_000, 70_000],
    "negative and large": [-5, -5, 0, -32768, -40_000, 2**40, 2**40 + 1],
    "with nulls": [None, None, 4, 4, 5],
    "one null": [None, 3],
    "empty": [],
}


@pytest.mark.parametrize("case", KEYS)
def test_counts_of_keys(spark, case):
    keys = KEYS[case]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    parts = [key_state(df.filter("k % 2 = 0 or k is null"), "k"), key_state(df.filter("k % 2 <> 0"), "k")]
    state = merge_states(parts[0].unionByName(parts[1]))
    real = {k for k in keys if k is not None}
    assert state.agg(distinct_keys(state).alias("d"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()[:] == (len(real), len(keys))
    assert repeated_keys(df, "k", state).first()["n"] == sum(keys.count(k) > 1 for k in set(keys))


def test_membership(spark):
    rng = random.Random(3)
    held = {rng.randrange(-100_000, 300_000) for _ in range(2000)}
    asked = [rng.randrange(-100_000, 300_000) for _ in range(3000)] + list(held)[:500] + [None]
    state = key_state(spark.createDataFrame([(k,) for k in held], "k long"), "k")
    got = with_membership(spark.createDataFrame([(a,) for a in asked], "a long"), "a", state, "found").collect()
    assert all(r["found"] == (r["a"] in held) for r in got) and len(got) == len(asked)


def test_every_bit_is_read(spark):
    state = key_state(spark.range(1, 65).filter("id % 3 = 0"), "id")
    got = spark.range(1, 65).join(state.select("bits")).select("id", has_bit(F.col("bits"), F.bitmap_bit_position("id")).alias("h")).collect()
    assert {r["id"] for r in got if r["h"]} == set(range(3, 65, 3))


def test_filter_misses_no_key(spark):
    keys = spark.range(5000).select((F.col("id") * 7).alias("k"))
    got = might_hold(spark.range(70_000), F.col("id"), keys, "hit")
    assert got.filter("hit and id % 7 = 0 and id < 35000").count() == 5000
    assert got.filter("hit").count() < 12_000
    assert might_hold(spark.range(10), F.col("id"), keys.limit(0), "hit").filter("hit").count() == 0


def test_small_tables_are_joined_without_a_filter(spark, monkeypatch):
    rows = spark.range(500).selectExpr("id % 300 as id", "id as _own")
    keys = spark.range(0, 1000, 7)
    for small in (True, False):
        if not small:
            monkeypatch.setattr("depotflow.operators.bitmaps.FILTERED_BYTES", 0)
        kept, left = only(rows, F.col("id"), keys), without(rows, F.col("id"), keys)
        assert kept.columns == left.columns == rows.columns
        assert sorted(r["_own"] for r in kept.collect()) == [k for k in range(500) if k % 300 % 7 == 0]
        assert sorted(r["_own"] for r in left.collect()) == [k for k in range(500) if k % 300 % 7]
        for out in (kept, left):
            assert ("bitmap_construct_agg" not in out._jdf.queryExecution().optimizedPlan().toString()) == small


def test_rows_are_not_sorted_to_set_their_bits(spark):
    state = key_state(spark.range(100_000).withColumn("odd", F.col("id") % 2), "id", [F.sum("odd").alias("c0")])
    assert "SortAggregate" not in state._jdf.queryExecution().executedPlan().toString()
    assert state.agg(F.sum("rows"), F.sum(F.bitmap_count("bits")), F.sum("c0")).first()[:] == (100_000, 100_000, 50_000)
