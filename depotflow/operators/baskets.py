"""Items picked together: session support, pair support and lift, best pairs per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from depotflow.functions.numbers import rounded
from depotflow.operators.joins import first_per_key
from depotflow.operators.positions import with_dense_key
from depotflow.session import stage

BLOCK_ITEMS = 256
ROUND_GROWTH = 64  # each round looks at so many times as many items as the one before
LIFT_DIGITS = 4


def cooccurring_pairs(
    picks: DataFrame, site: str, session: list[str], item: str, top: int = 200, probe: int = 512
) -> DataFrame:
    """The `top` pairs with the highest lift (> 1) per site: sku_id_1 < sku_id_2, ties in id order.

    Only sessions with at least two different items count. lift = c_ab * N / (c_a * c_b), rounded to 4 digits.

    Counting every pair of every session would grow with the square of a session. A lift of t needs
    c_ab >= t * c_a * c_b / N common sessions, so a threshold cuts twice. An item with N / c < t has no such pair at all, and two items
    with one share a session among the first few of both (`prefix_probes`), small sessions first. The threshold is the lift
    that `top` pairs reach: of the `probe` rarest items in the first round, of ROUND_GROWTH times as many in each
    further one, so it rises as the items get more popular; the last round takes all that are left.
    Items with identical sets of sessions are interchangeable, so of each such group only the first top + 1 by id can
    appear in the result; sets are told apart by their size and two 64-bit fingerprints. No cut changes the result.
    """
    keys = [site, *session]
    baskets = stage(picks.select(*keys, F.col(item).alias("item")).dropna().distinct())
    sizes = baskets.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).filter("_size >= 2")
    sessions = with_dense_key(sizes, "_s", ["_size", *keys])  # small sessions have small numbers
    kept = stage(baskets.join(sessions.drop("_size"), keys).select(site, "_s", "item"))
    totals = sessions.groupBy(site).agg(F.count(F.lit(1)).alias("n"))
    prints = [F.bit_xor(F.xxhash64("_s", F.lit(seed))).alias(f"_print{seed}") for seed in (1, 2)]
    items = (
        kept.groupBy(site, "item")
        .agg(F.count(F.lit(1)).alias("c"), *prints)
        .join(totals, site)
        .withColumn("bound", rounded(F.col("n") / F.col("c"), LIFT_DIGITS))
    )
    items = stage(first_per_key(items, [site, "c", "_print1", "_print2"], ["item"], top + 1).drop("_print1", "_print2"))
    most = items.groupBy(site).count().agg(F.max("count")).first()[0] or 0

    chosen, share = with_threshold(first_per_key(items, [site], ["c", "item"], probe), site), probe
    while True:
        pairs = best_pairs(pair_lifts(kept, chosen, site), site, top)
        if share >= most:
            return pairs
        reached = stage(
            pairs.groupBy(site)
            .agg(F.count(F.lit(1)).alias("_found"), F.min("lift_score").alias("reached"))
            .filter(F.col("_found") >= top)
            .select(site, "reached")
        )
        share *= ROUND_GROWTH
        chosen = with_threshold(items, site, reached)
        if share < most:
            chosen = rarest(chosen, site, share)


def with_threshold(items: DataFrame, site: str, reached: DataFrame | None = None) -> DataFrame:
    """Items that a pair of the lift reached so far can have, with that lift as `t` (1 where none is known)."""
    if reached is None:
        return items.withColumn("t", F.lit(1.0))
    known = items.join(reached, site, "left").filter(F.col("reached").isNull() | (F.col("bound") >= F.col("reached")))
    # a lift that rounds to the one reached may lie below it
    return known.withColumn("t", F.greatest(F.coalesce("reached", F.lit(1.0)) - 10.0**-LIFT_DIGITS, F.lit(1.0))).drop("reached")


def rarest(items: DataFrame, site: str, share: int) -> DataFrame:
    """At least the `share` items of lowest support per site, whole supports only; counts them by support, not one by one."""
    supports = items.groupBy(site, "c").count()
    before = F.sum("count").over(Window.partitionBy(site).orderBy("c")) - F.col("count")
    cut = supports.withColumn("_before", before).filter(F.col("_before") < share).groupBy(site).agg(F.max("c").alias("_cut"))
    return items.join(cut, site).filter(F.col("c") <= F.col("_cut")).drop("_cut")


def least_common(c: Column | str, other: Column | str) -> Column:
    """Sessions that two items of these supports must share for a lift of t among n sessions."""
    c, other = (F.col(x) if isinstance(x, str) else x for x in (c, other))
    return F.greatest(F.ceil(F.col("t") * c * other / F.col("n") - 1e-9), F.lit(1))


def prefix_probes(members: DataFrame, site: str) -> DataFrame:
    """Rows by which a pair can meet: (site, _s, lo, hi: classes of both supports, upper: own class is hi, full, item, c, n, t).

    A class holds the supports from 2^k to 2^(k+1) - 1. An item that must share o sessions with any item of a class has one in common with it
    among its first c - o + 1 sessions, so only these are kept for that class; none if no partner there can share as many.
    """
    order = Window.partitionBy(site, "item").orderBy("_s")
    own = F.length(F.bin("c")) - 1
    placed = members.withColumns({"_k": own, "_pos": F.row_number().over(order)})
    classes = members.groupBy(site).agg(F.sort_array(F.collect_set(own)).alias("_classes"))  # at most one for each binary digit
    smallest = lambda j: F.pow(F.lit(2.0), j)

    def meets(j: Column) -> Column:
        common = least_common("c", smallest(j))
        return (common <= F.least(F.col("c"), smallest(j) * 2 - 1)) & (F.col("_pos") <= F.col("c") - common + 1)

    return (
        placed.join(classes, site)
        .withColumn("_j", F.explode(F.filter("_classes", meets)))
        .select(
            site, "_s", F.least("_k", "_j").alias("lo"), F.greatest("_k", "_j").alias("hi"), (F.col("_k") >= F.col("_j")).alias("_right"),
            (F.col("_k") <= F.col("_j")).alias("_left"), (least_common("c", smallest(F.col("_j"))) == 1).alias("full"), "item", "c", "n", "t",
        )
    )


def prefix_matches(members: DataFrame, site: str) -> DataFrame:
    """Pairs that share a session among their first ones, once for each such session: (site, a, b, c_a, c_b, n, t, full).

    The left rows of a large session are spread over blocks of about BLOCK_ITEMS items, each joined with
    a copy of the session, so one busy session does not become one task. Where `full` is set, all sessions of both were compared.
    """
    keys = [site, "_s", "lo", "hi"]
    probes = stage(prefix_probes(members, site))
    sizes = probes.groupBy(*keys).agg(F.ceil(F.count_if("_left") / BLOCK_ITEMS).cast("int").alias("_blocks"), F.count_if("_right").alias("_r"))
    probes = probes.join(sizes.filter("_blocks > 0 and _r > 0").drop("_r"), keys)
    block = F.pmod(F.xxhash64("item"), F.col("_blocks")).cast("int")
    left = probes.filter("_left").select(*keys, block.alias("_block"), F.col("item").alias("a"), F.col("c").alias("c_a"), "n", "t", F.col("full").alias("_fa"))
    right = probes.filter("_right").select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), F.col("item").alias("b"), F.col("c").alias("c_b"),
        F.col("full").alias("_fb"),
    )
    apart = (F.col("lo") < F.col("hi")) | (F.col("a") < F.col("b"))
    reachable = least_common("c_a", "c_b") <= F.least("c_a", "c_b")
    return left.join(right, [*keys, "_block"]).filter(apart & reachable).select(
        site, "a", "b", "c_a", "c_b", "n", "t", (F.col("_fa") & F.col("_fb")).alias("full")
    )


def pair_lifts(baskets: DataFrame, items: DataFrame, site: str) -> DataFrame:
    """Support and lift of pairs of the given items (site, item, c, n, t): all pairs whose lift is at least t and above 1.

    `baskets` has (site, _s, item). Pairs that met in part of their sessions only are counted in a second join, on the
    sessions of the rarer item.
    """
    members = stage(baskets.join(items.select(site, "item", "c", "n", "t"), [site, "item"]))
    met = stage(prefix_matches(members, site).groupBy(site, "a", "b", "c_a", "c_b", "n", "full").agg(F.count(F.lit(1)).alias("co_occurrence_count")))
    partly = met.filter("not full").drop("co_occurrence_count")
    rare_first = F.col("c_a") <= F.col("c_b")
    asked = partly.withColumns({"_rare": F.when(rare_first, F.col("a")).otherwise(F.col("b")), "_other": F.when(rare_first, F.col("b")).otherwise(F.col("a"))})
    where = members.select(site, "_s", F.col("item").alias("_rare"))
    holds = members.select(site, "_s", F.col("item").alias("_other"))
    counted = (
        asked.join(where, [site, "_rare"]).join(holds, [site, "_s", "_other"], "left_semi")
        .groupBy(*partly.columns).agg(F.count(F.lit(1)).alias("co_occurrence_count"))
    )
    pairs = met.filter("full").unionByName(counted)
    product = F.col("c_a") * F.col("c_b")
    joint = F.col("co_occurrence_count") * F.col("n")
    return pairs.filter(joint > product).select(
        site, F.least("a", "b").alias("sku_id_1"), F.greatest("a", "b").alias("sku_id_2"), "co_occurrence_count",
        rounded(joint.cast("double") / product, LIFT_DIGITS).alias("lift_score"),
    )


def best_pairs(pairs: DataFrame, site: str, n: int) -> DataFrame:
    return first_per_key(pairs, [site], [F.col("lift_score").desc(), "sku_id_1", "sku_id_2"], n)
