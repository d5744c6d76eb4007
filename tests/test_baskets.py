"""Best pairs against counting all pairs by hand."""

import random
from collections import Counter
from itertools import combinations

import pytest

from pyspark.sql import functions as F

from depotflow.operators import baskets
from depotflow.operators.baskets import cooccurring_pairs, prefix_matches


def by_hand(picks, top):
    result = []
    for site in {p[0] for p in picks}:
        sessions = {}
        for s, day, item in picks:
            if s == site and item is not None:
                sessions.setdefault(day, set()).add(item)
        sessions = [x for x in sessions.values() if len(x) >= 2]
        support, pairs = Counter(), Counter()
        for items in sessions:
            support.update(items)
            pairs.update(combinations(sorted(items), 2))
        n = len(sessions)
        lifts = [
            (site, a, b, c, int(c * n / (support[a] * support[b]) * 10000 + 0.5) / 10000)
            for (a, b), c in pairs.items()
            if c * n > support[a] * support[b]
        ]
        result += sorted(lifts, key=lambda r: (-r[4], r[1], r[2]))[:top]
    return sorted(result)


def random_picks(seed, items, sessions, size, popular=0.0):
    rng = random.Random(seed)
    picks = []
    for site in ("A", "B"):
        for day in range(sessions):
            for _ in range(rng.randint(1, size)):
                item = 0 if rng.random() < popular else int(items * rng.random() ** 2)
                picks.append((site, day, f"i{item:04d}"))
    return picks


CASES = {
    "dense": random_picks(1, 12, 30, 10),
    "sparse": random_picks(2, 200, 40, 8),
    "popular item": random_picks(3, 60, 40, 12, popular=0.4),
    "one huge session of once-only items": random_picks(4, 50, 20, 6) + [("A", 99, f"z{i:04d}") for i in range(700)],
    "interchangeable items": [("A", d, f"i{i:03d}") for d in (1, 2) for i in range(60)] + random_picks(5, 30, 25, 8),
    "single-item sessions": [("A", d, "i1") for d in range(5)],
    "repeats and missing": [("A", 1, "a"), ("A", 1, "a"), ("A", 1, "b"), ("A", 2, None), ("A", 2, "a"), ("A", 3, "c"), ("A", 3, "b")],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("top, probe", [(3, 2), (20, 10), (200, 512)])
def test_best_pairs(spark, case, top, probe):
    df = spark.createDataFrame(CASES[case], "site string, day int, item string")
    got = cooccurring_pairs(df, "site", ["day"], "item", top, probe)
    assert sorted(map(tuple, got.collect())) == by_hand(CASES[case], top)


@pytest.mark.parametrize("case", ["sparse", "popular item", "interchangeable items"])
def test_more_rounds_give_the_same_pairs(spark, monkeypatch, case):
    monkeypatch.setattr(baskets, "ROUND_GROWTH", 2)
    df = spark.createDataFrame(CASES[case], "site string, day int, item string")
    assert sorted(map(tuple, cooccurring_pairs(df, "site", ["day"], "item", 5, 4).collect())) == by_hand(CASES[case], 5)


def members_of(df):
    """(site, _s, item, c, n, t) of (s, item), without a threshold."""
    support = df.groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    n = df.select("s").distinct().count()
    return df.join(support, "item").select(F.lit("A").alias("site"), F.col("s").alias("_s"), "item", "c", F.lit(n).cast("long").alias("n"), F.lit(1.0).alias("t"))


def test_a_session_of_20000_items_joins_few_rows(spark):
    """Every item also has a small session with one partner: the best lift needs two common sessions, and the small one comes first."""
    items = 20_000
    pairs = spark.range(items).select((F.col("id") / 2).cast("long").alias("s"), F.format_string("i%05d", "id").alias("item"))
    huge = spark.range(items).select(F.lit(1_000_000).cast("long").alias("s"), F.format_string("i%05d", "id").alias("item"))
    members = members_of(pairs.unionByName(huge)).withColumn("t", F.col("n") / 2 - 1e-4)
    assert prefix_matches(members, "site").count() == items // 2
    picks = pairs.unionByName(huge).select(F.lit("A").alias("site"), "s", "item")
    got = cooccurring_pairs(picks, "site", ["s"], "item", 200, 512).collect()
    n = items // 2 + 1
    assert len(got) == 200 and {(r["co_occurrence_count"], r["lift_score"]) for r in got} == {(2, n / 2)}
    assert min(r["sku_id_1"] for r in got) == "i00000"


def test_a_dense_overlap_joins_only_the_first_sessions(spark):
    """60 items in nearly the same 400 of 4,000 sessions: a lift near the highest possible leaves short prefixes."""
    rng = random.Random(8)
    rows = [(s, f"d{i:02d}") for i in range(60) for s in range(400) if rng.random() < 0.97]
    rows += [(s, f"f{s % 900:03d}") for s in range(4000)] + [(s, f"g{s % 700:03d}") for s in range(4000)]
    members = members_of(spark.createDataFrame(rows, "s long, item string"))
    dense = members.filter("item like 'd%'")
    everything = dense.join(dense.select("_s", F.col("item").alias("other")), "_s").filter("item < other").count()
    joined = prefix_matches(dense.withColumn("t", F.lit(9.5)), "site")
    assert 0 < joined.count() < everything / 2
    picks = spark.createDataFrame([("A", s, i) for s, i in rows], "site string, day int, item string")
    assert sorted(map(tuple, cooccurring_pairs(picks, "site", ["day"], "item", 40, 20).collect())) == by_hand([("A", s, i) for s, i in rows], 40)
