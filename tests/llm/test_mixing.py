from __future__ import annotations

import random

import numpy as np
import pytest

from depotflow.llm.mixing import DOMAINS, fit_steps, label_domain, mix, resample

WORDS = {"plain": ["meadow", "river", "stone"], "toxic": ["curse", "spit", "sneer"], "junk": ["buy!!", "now!!", "click"]}


def corpus(frame, n=600, seed=1):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        domain = rnd.choices(DOMAINS, [0.2, 0.7, 0.1])[0]
        text = " ".join(rnd.choices(WORDS[domain] + ["the", "of", "and"] * 2, k=rnd.randrange(10, 60)))
        rows.append((i, text, domain))
        if i % 2:
            labels.append((i, 0 if domain == "junk" else 1, int(domain == "toxic")))
    labels = frame("doc_id long, quality int, toxic int", labels).select("doc_id", label_domain().alias("domain"))
    return frame("doc_id long, text string, rate string", rows), labels


def totals(rows):
    w = np.array([r["n_tokens"] for r in rows], float)
    p = np.array([r["posterior"] for r in rows])
    rate = np.array([r["rate"] for r in rows])
    return (w * rate) @ p / w.sum(), rate


def test_expected_tokens_meet_the_targets(frame):
    docs, labels = corpus(frame)
    rows = mix(docs, labels, {"plain": 0.5, "toxic": 0.3, "junk": 0.2}, budget=1.5).collect()
    got, rate = totals(rows)
    assert np.allclose(got, 1.5 * np.array([0.2, 0.5, 0.3]), atol=1e-4) and rate.min() >= 0
    assert abs(sum(r["copies"] for r in rows) / rate.sum() - 1) < 0.1
    assert all(abs(r["copies"] - r["rate"]) < 1 for r in rows)


def test_posteriors_know_the_unlabelled_documents(frame):
    docs, labels = corpus(frame)
    truth = {r["doc_id"]: r["rate"] for r in docs.collect()}
    rows = [r for r in mix(docs, labels, {"plain": 1}).collect() if r["doc_id"] % 2 == 0]
    right = sum(DOMAINS[int(np.argmax(r["posterior"]))] == truth[r["doc_id"]] for r in rows)
    assert right >= 0.97 * len(rows) and all(abs(sum(r["posterior"]) - 1) < 1e-9 for r in rows)


def test_clipped_rates_are_the_least_squares_optimum(spark, frame):
    """Where targets can't be met, no change of the rates within their bounds gets closer."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    w = rng.integers(1, 50, 200)
    members = frame("n_tokens long, posterior array<double>", [(int(a), b.tolist()) for a, b in zip(w, p)])
    for floor, targets in ((0.0, [0.2, 0.0, 0.8]), (1.0, [0.5, 1.2, 0.1]), (0.5, [0.3, 0.3, 0.4])):
        steps = fit_steps(members, targets, floor)
        rate = ahead = np.full(200, max(1.0, floor))
        for s in steps:
            new = np.maximum(ahead + p @ s[1:], floor)
            rate, ahead = new, new + s[0] * (new - rate)
        share = w / w.sum()
        miss = lambda r, t=targets, s=share: np.square(np.array(t) - (s * r) @ p).sum()
        best = np.full(200, max(1.0, floor))
        for _ in range(20_000):  # plain projected gradient as the yardstick
            best = np.maximum(best + 0.5 * p @ (np.array(targets) - (share * best) @ p), floor)
        assert miss(rate) <= miss(best) + 0.002 and miss(rate) < 0.1 * miss(np.full(200, max(1.0, floor))), (floor, miss(rate), miss(best))


def test_resample_repeats_rows(frame):
    docs, labels = corpus(frame, 200)
    weights = lambda rows: mix(rows, labels, {"plain": 0.9, "toxic": 0.1}, budget=2.0, floor=1.0)
    copies = {r["doc_id"]: r["copies"] for r in weights(docs).collect()}
    own = docs.drop("rate").selectExpr("*", "7.5D as rate", "'mine' as copies", "1 as row", "2 as n_tokens")
    again = resample(own, weights)
    assert again.columns == own.columns and {(r["rate"], r["copies"]) for r in again.collect()} == {(7.5, "mine")}
    counts = {r["doc_id"]: r["count"] for r in again.groupBy("doc_id").count().collect()}
    assert counts == {i: c for i, c in copies.items() if c} and min(copies.values()) >= 1


def test_odd_inputs(frame):
    docs = frame("doc_id long, text string, copies string", [(1, None, "a"), (1, "", "b"), (None, "x y", "c"), (1, "", "b")])
    none = frame("doc_id long, domain string", [])
    rows = mix(docs, none, {"plain": 1.0}).collect()
    assert len(rows) == 4 and all(np.allclose(r["posterior"], 1 / 3) for r in rows)
    assert mix(docs.limit(0), none, {"plain": 1.0}).count() == 0
    empty = mix(docs.filter("text = ''"), none, {"plain": 1.0}).collect()
    assert [r["rate"] for r in empty] == [1.0, 1.0]
    odd = frame("doc_id long, domain string", [(1, None), (1, "other"), (None, "plain")])
    assert mix(docs, odd, {"plain": 1.0}).count() == 4
    with pytest.raises(ValueError):
        mix(docs, none, {"plain": -1.0})


def test_label_domains(frame):
    rows = frame("quality int, toxic int", [(0, 1), (1, 1), (1, 0), (None, 0), (1, None)]).select(label_domain().alias("d"))
    assert [r["d"] for r in rows.collect()] == ["junk", "toxic", "plain", None, None]
