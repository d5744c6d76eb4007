"""Interval joins against nested loops in Python."""

import random
from datetime import date, datetime, timedelta

from depotflow.operators.intervals import as_of, distinct_keys_overlapping, overlapping

START = date(2022, 1, 1)


def test_overlaps_once_each(frame):
    rng = random.Random(1)

    def spans(n):
        days = [(rng.randrange(500), rng.randrange(-3, 90)) for _ in range(n)]
        return [(k, rng.choice("ab"), START + timedelta(a), START + timedelta(a + b)) for k, (a, b) in enumerate(days)]

    left, right = spans(80), spans(60) + [(99, "a", None, START), (98, "a", START, None)]
    l, r = frame("i int, g string, s date, e date", left), frame("j int, g string, s2 date, e2 date", right)
    meets = lambda x, y: None not in y and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and x[3] >= y[2]
    got = sorted((x.i, x.j) for x in overlapping(l, r.drop("g"), ("s", "e"), ("s2", "e2")).collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if meets(x, y))
    got = sorted((x.i, x.j) for x in overlapping(l, r, ("s", "e"), ("s2", "e2"), ["g"]).collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if meets(x, y) and x[1] == y[1])
    some = distinct_keys_overlapping(l, ("s", "e"), r.filter("j < 2").select("s2", "e2"), ("s2", "e2"), "g").collect()
    assert {(x.g, x.s2) for x in some} == {(x[1], y[2]) for x in left for y in right[:2] if meets(x, y)}


def history(rng, keys):
    rows = []
    for key in keys:
        at = START + timedelta(rng.randrange(60))
        for _ in range(rng.randrange(6)):
            length = rng.choice([1, 2, 10, 40, 200])
            rows.append((key, len(rows), datetime.combine(at, datetime.min.time()), datetime.combine(at + timedelta(length), datetime.min.time())))
            at += timedelta(length + rng.choice([0, 0, 5]))
        if rng.random() < 0.7:
            rows.append((key, len(rows), datetime.combine(at, datetime.min.time()), None))
    return rows


def test_every_fact_meets_the_version_of_its_day(frame):
    rng = random.Random(2)
    versions = history(rng, [f"k{n}" for n in range(12)]) + [(None, -1, datetime(2022, 1, 1), None), ("k1", -2, None, None)]
    facts = [(n, rng.choice([None, "none", *[f"k{m}" for m in range(12)]]), rng.choice([None, *[START + timedelta(m) for m in range(700)]])) for n in range(800)]
    facts += [(800 + n, "k3", START + timedelta(65)) for n in range(300)]  # a hot key and day
    expected = {}
    for n, key, day in facts:
        at = day and datetime.combine(day, datetime.min.time())
        hits = [v for k, v, a, b in versions if at and key and k == key and a and a <= at and (b is None or b > at)]
        expected[n] = hits[0] if hits else None
    h = frame("k string, v int, valid_from timestamp, valid_to timestamp", versions)
    for days in (1, 8, 32):
        got = as_of(frame("n int, k string, day date", facts), h, "k", "day", ["v"], days)
        assert {r.n: r.v for r in got.collect()} == expected and got.count() == len(facts)
        text = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text
    assert as_of(frame("n int, k string, day date", []), h, "k", "day", ["v"]).count() == 0
    assert as_of(frame("n int, k string, day date", facts), h.limit(0), "k", "day", ["v"]).filter("v is null").count() == len(facts)
