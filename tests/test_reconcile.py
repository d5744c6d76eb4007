"""Deliveries against stored days: only months with an unequal day are written."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from depotflow.sources.reconcile import MONTH, day_prints, in_months, reconcile, unequal_days
from depotflow.sources.tables import TableStore

DDL = "day date, item string, qty int"
FIRST = [
    (date(2024, 1, 1), "a", 1), (date(2024, 1, 1), "a", 1), (date(2024, 1, 2), "b", None), (date(2024, 2, 1), "a", 3),
    (date(2024, 3, 1), "c", 4), (None, "n", 1),
]


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path))


def rows(df):
    return sorted(map(tuple, df.drop(MONTH).collect()), key=repr)


def files(store):
    held = store.read("t").select(MONTH, F.input_file_name().alias("f")).distinct().collect()
    return {(r[MONTH], r.f) for r in held}


def verdicts(report):
    return {r.day: (r.rows_before, r.rows_after, r.verdict) for r in report.collect()}


def test_only_touched_months_are_written(frame, store):
    assert len(verdicts(reconcile(store, "t", frame(DDL, FIRST), "day"))) == 5
    before = files(store)
    second = [r for r in FIRST if r[0] != date(2024, 1, 2)] + [(date(2024, 1, 1), "late", 9), (date(2024, 4, 1), "d", 1)]
    report = verdicts(reconcile(store, "t", frame(DDL, second), "day"))
    assert report == {
        date(2024, 1, 1): (2, 3, "mended"), date(2024, 1, 2): (1, 0, "kept"), date(2024, 4, 1): (0, 1, "new"),
    }
    # the day that the delivery lacks stays, though its month was rewritten
    assert rows(store.read("t")) == sorted([*second, (date(2024, 1, 2), "b", None)], key=repr)
    unchanged = {(m, f) for m, f in before if m != 202401}
    assert unchanged <= files(store) and not {f for m, f in before if m == 202401} & {f for _, f in files(store)}


def test_a_repeated_delivery_changes_nothing(frame, store):
    reconcile(store, "t", frame(DDL, FIRST), "day")
    before = files(store)
    assert verdicts(reconcile(store, "t", frame(DDL, FIRST[::-1]), "day")) == {} and files(store) == before


def test_rows_without_a_day_are_mended(frame, store):
    reconcile(store, "t", frame(DDL, FIRST), "day")
    changed = [*FIRST[:-1], (None, "n", 2)]
    assert verdicts(reconcile(store, "t", frame(DDL, changed), "day")) == {None: (1, 1, "mended")}
    assert rows(store.read("t")) == sorted(changed, key=repr)


def test_empty_deliveries(frame, store):
    assert verdicts(reconcile(store, "t", frame(DDL, []), "day")) == {}
    reconcile(store, "t", frame(DDL, FIRST), "day")
    assert {v for *_, v in verdicts(reconcile(store, "t", frame(DDL, []), "day")).values()} == {"kept"}
    assert rows(store.read("t")) == sorted(FIRST, key=repr)


@pytest.mark.parametrize("one, other", [
    ([("x", None)], [(None, "x")]),  # a null in another column
    ([("x", "y"), ("x", "y")], [("x", "y")]),  # a repeated row
    ([("x", "y"), ("z", "w")], [("x", "w"), ("z", "y")]),  # values swapped between rows
])
def test_prints_tell_days_apart(frame, one, other):
    ddl = "day date, a string, b string"
    left, right = (day_prints(frame(ddl, [(date(2024, 1, 1), *r) for r in some]), "day", ["a", "b"]) for some in (one, other))
    assert unequal_days(left, right).count() == 1 and unequal_days(left, left).count() == 0


def test_months_prune_partitions(frame, store):
    reconcile(store, "t", frame(DDL, FIRST), "day")
    read = store.read("t").filter(in_months([202402]))
    assert read.inputFiles() and "PartitionFilters: [isnotnull(month" in read._jdf.queryExecution().executedPlan().toString()
    assert rows(read) == [(date(2024, 2, 1), "a", 3)]
