"""Mixing to target weights with soft membership, with DataFrame operations only.

A classifier learned from the labelled table gives every document a posterior for each domain. Rates are then fitted so
that the expected tokens of each domain, the sum of rate * tokens * posterior over all documents, come closest to their
targets in the least-squares sense, with every rate at or above a floor of at least zero. The fit is a projected gradient:
starting from rate 1, each step moves all rates along their posteriors and clips them at the floor. A step needs a few sums over
all documents and no state but the list of steps so far, from which a row computes its own rate.

The classifier is a naive Bayes over hashed words. It is fitted on at most `SAMPLE` labelled documents, chosen by hash;
only buckets whose frequency differs between domains beyond chance, and clearly, count.

Nulls: a null text is empty; an empty text has the prior as posterior, no tokens, and a rate. Labels with nulls don't count.
Repeated rows are rated alike. Without labels all domains are equally likely. Targets are weights and must not be negative.
"""

from __future__ import annotations

from collections.abc import Callable

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from depotflow.llm.common import stage

SAMPLE, BUCKETS, LEAST_Z, LEAST_RATIO = 20_000, 8_192, 6.0, 1.0
STEPS, CLOSE, PATIENCE = 60, 1e-6, 10
UNIFORM = 1 << 30
DOMAINS = ("junk", "plain", "toxic")


def label_domain() -> Column:
    """The domain of a row of `labels`."""
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "plain")
    return F.when(F.col("quality").isNotNull(), domain)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), "\n\t\r.,", "     "), " "), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _numbers(values: np.ndarray) -> Column:
    """An array literal that costs one string in the plan."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def _adder(ratios: Column):
    return lambda total, bucket: total + F.get(ratios, bucket)


def fit_weights(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of no telling bucket by domain, and what each bucket adds; from at most `sample` labelled documents."""
    known = labelled.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(*domains))
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id")).limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # `sample` bounds it
    seen = rows.select("domain", F.explode(F.array_distinct(F.transform(_words(F.col("text")), _bucket))).alias("bucket"))
    n = np.zeros(len(domains))
    for r in rows.groupBy("domain").count().collect():
        n[domains.index(r["domain"])] = r["count"]
    holds = np.zeros((BUCKETS, len(domains)))
    for r in seen.groupBy("domain", "bucket").count().collect():  # BUCKETS * domains rows
        holds[r["bucket"], domains.index(r["domain"])] = r["count"]
    # share of a domain's documents that hold the bucket, against that of the other domains
    others, rest = holds.sum(axis=1, keepdims=True) - holds, n.sum() - n
    both = (holds + others + 1) / (n.sum() + 2)
    p, q = (holds + 2 * both) / (n + 2), (others + 2 * both) / (rest + 2)
    z = (p - q) / np.sqrt(both * (1 - both) * (1 / np.maximum(n, 1) + 1 / np.maximum(rest, 1)) + 1e-12)
    telling = ((np.abs(z) >= LEAST_Z) & (np.abs(np.log(p / q)) >= LEAST_RATIO) & (n > 0) & (rest > 0)).any(axis=1, keepdims=True)
    present, absent = (np.where(telling, np.log(x), 0.0) for x in (p, 1 - p))
    prior = np.log((n + 1) / (n.sum() + len(domains))) + absent.sum(axis=0)
    return prior, present - absent


def posteriors(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...] = DOMAINS, sample: int = SAMPLE) -> DataFrame:
    """`docs` with n_tokens (words) and posterior (array, in the order of `domains`)."""
    prior, weights = fit_weights(docs, labelled, domains, sample)
    telling = _numbers((weights != 0).any(axis=1).astype(float))
    scored = docs.withColumn("_mx_all", F.transform(_words(F.col("text")), _bucket))
    scored = scored.withColumn("n_tokens", F.size("_mx_all").cast("long"))
    scored = scored.withColumn("_mx_all", F.array_distinct(F.filter("_mx_all", lambda b: F.get(telling, b) > 0)))
    for k in range(len(domains)):
        ratios = _numbers(weights[:, k])
        total = F.aggregate("_mx_all", F.lit(float(prior[k])), _adder(ratios))
        scored = scored.withColumn(f"_mx_{k}", total)
    logs = [F.col(f"_mx_{k}") for k in range(len(domains))]
    top = F.greatest(*logs)
    parts = scored.withColumn("_mx_exp", F.array(*[F.exp(x - top) for x in logs]))
    norm = F.aggregate("_mx_exp", F.lit(0.0), lambda s, x: s + x)
    return parts.withColumn("posterior", F.transform("_mx_exp", lambda x: x / norm)).drop("_mx_all", "_mx_exp", *[f"_mx_{k}" for k in range(len(domains))])


def _moved(steps: list[np.ndarray], domains: int, floor: float) -> Column:
    """A row's rate after the steps so far, and the point ahead that the next one starts from.

    A step is its momentum and one move for each domain: it moves the point ahead along the row's posterior, and the floor clips it.
    """
    begin = F.struct(F.lit(max(1.0, floor)).alias("rate"), F.lit(max(1.0, floor)).alias("ahead"))
    if not steps:
        return begin
    moves = F.array(*[F.array(*[F.lit(float(v)) for v in step]) for step in steps])

    def move(at: Column, step: Column) -> Column:
        along = sum((F.get(step, k + 1) * F.get("posterior", k) for k in range(domains)), F.lit(0.0))
        rate = F.greatest(at["ahead"] + along, F.lit(floor))
        return F.struct(rate.alias("rate"), (rate + F.get(step, 0) * (rate - at["rate"])).alias("ahead"))

    return F.aggregate(moves, begin, move)


def fit_steps(members: DataFrame, targets: list[float], floor: float) -> list[np.ndarray]:
    """The steps of the projected gradient; members: n_tokens and posterior of every document, staged.

    First steps are scaled by the inverse Hessian of the documents free to move, which meets targets that can be met at once. When
    such a step no longer closes half the gap it is taken back, and accelerated gradient steps of safe length go on.
    """
    d, wanted = len(targets), np.array(targets)
    total = members.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    if not total:
        return []
    steps: list[np.ndarray] = []
    share = F.col("n_tokens") / F.lit(float(total))
    p = [F.get("posterior", k) for k in range(d)]
    scaled, momentum, misses = True, 0, [math.inf]
    for _ in range(STEPS):
        rated = members.withColumn("_at", _moved(steps, d, floor))
        rate, ahead = F.col("_at.rate"), F.col("_at.ahead")
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        sums = [F.sum(share * x * p[k]) for x in (rate, ahead) for k in range(d)]
        sums += [F.sum(share * weight * p[i] * p[j]) for weight in (F.lit(1.0), (rate > floor).cast("double")) for i, j in pairs]
        got = np.array(rated.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first(), float)
        miss = float(np.square(wanted - got[:d]).sum())
        if miss < CLOSE**2:
            break
        if scaled and steps and miss > 0.25 * misses[-1]:
            steps.pop()
            scaled = False
            continue
        if not scaled and len(misses) > PATIENCE and miss > 0.99 * misses[-PATIENCE]:
            break
        momentum = 0 if miss > misses[-1] else momentum + 1
        misses.append(miss)
        hessian, free = (np.zeros((d, d)) for _ in range(2))
        for matrix, values in ((hessian, got[2 * d :]), (free, got[2 * d + len(pairs) :])):
            for (i, j), v in zip(pairs, values):
                matrix[i, j] = matrix[j, i] = v
        gap = wanted - got[d : 2 * d]
        if scaled:
            some = free if np.trace(free) > 0 else hessian
            steps.append(np.concatenate(([0.0], np.linalg.solve(some + 1e-9 * np.eye(d), gap))))
        else:
            steps.append(np.concatenate(([momentum / (momentum + 3)], gap / np.linalg.eigvalsh(hessian)[-1])))
    return steps


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float = 1.0, floor: float = 0.0,
    domains: tuple[str, ...] = DOMAINS, sample: int = SAMPLE,
) -> DataFrame:
    """`docs` with n_tokens, posterior, rate and copies.

    targets: weight of each domain; budget: tokens wanted, as a multiple of those there are. copies is the rate rounded
    up or down at random by a hash of the id, so its expectation is the rate. Columns of these names are replaced.
    """
    if floor < 0 or min(targets.values()) < 0 or sum(targets.values()) <= 0:
        raise ValueError("targets and floor must not be negative, and some target must be positive")
    rows = posteriors(docs, labelled, domains, sample)
    members = stage(rows.select("n_tokens", "posterior"))
    whole = sum(targets.values())
    steps = fit_steps(members, [budget * targets.get(x, 0.0) / whole for x in domains], floor)
    nameless = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))  # rows without an id draw by their text
    chance = F.pmod(F.xxhash64("doc_id", nameless, F.lit("mix")), F.lit(UNIFORM)) / F.lit(float(UNIFORM))
    rated = rows.withColumn("rate", _moved(steps, len(domains), floor)["rate"])
    return rated.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("int"))


def resample(docs: DataFrame, mixed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every row of `docs` as often as the copies that `mixed` gives it say; all columns stay what they were, whatever their names."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    return mixed(packed).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
