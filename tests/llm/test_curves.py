from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from depotflow.llm import curves
from depotflow.llm.curves import hilbert_keys, nearest
from depotflow.operators import positions

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def exact(rows, every, k=10):
    good = {i: np.array(v, float) for i, v in rows if v is not None and not any(x is None or not np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if q % every == 0:
            near = sorted((float(np.sqrt(np.square(good[i] - good[q]).sum())), i) for i in good if i != q)
            out[q] = near[:k]
    return out


def run(frame, rows, every=10, **options):
    table = frame(SCHEMA, [(i, v, 1, "own") for i, v in rows])
    out = {}
    for r in nearest(table, F.col("vec_id") % every == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_a_curve_visits_every_cell_by_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_recall_on_vectors_without_structure(frame):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    truth, got = exact(rows, 40), run(frame, rows, 40)
    hits = sum(len({i for _, i in truth[q]} & {i for _, i in got[q]}) for q in truth)
    assert got.keys() == truth.keys() and hits >= 0.9 * 10 * len(truth)


def test_small_tables_are_exact_with_ties_and_repeats(frame):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-1, 2, 4).astype(float).tolist()) for i in range(90)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(100, 160)]
    assert run(frame, rows) == exact(rows, 10)


def test_unusable_vectors_take_no_part(frame):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 2.0]), (10, None), (11, [0.0, 0.0]), (12, [None, 1.0]), (13, [float("nan"), 1.0]), (20, [float("inf"), 1.0]), (30, [1.0, 2.5])]
    got = run(frame, [*rows, (40, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])])
    assert got == exact(rows, 10) and set(got) == {0, 30}
    assert run(frame, []) == {}


def test_windows_widen_to_the_recall_that_is_measured(frame):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    truth, got = exact(rows, 40), run(frame, rows, 40, window=0.1)
    assert sum(len({i for _, i in truth[q]} & {i for _, i in got[q]}) for q in truth) >= 0.9 * 10 * len(truth)


def test_vectors_are_staged_once_and_not_for_every_ordering(frame, monkeypatch):
    rng, staged = np.random.default_rng(6), []
    for module in (curves, positions):
        monkeypatch.setattr(module, "stage", lambda df, plain=module.stage: staged.append(plain(df)) or staged[-1])
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(300, 8)).astype(np.float32).tolist())]
    assert run(frame, rows) == exact(rows, 10)
    assert {f.count() for f in staged if "v" in f.columns} == {300}


def test_blocks_and_parts_give_what_one_group_gives(frame, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, v) for i, v in enumerate(rng.integers(-2, 3, (400, 4)).astype(float).tolist()) if any(v)]
    whole = run(frame, rows, 7)
    for name, value in (("ROWS", 60), ("QUERIES", 9), ("AT_ONCE", 4)):
        monkeypatch.setattr(curves, name, value)
    assert run(frame, rows, 7) == whole


def test_zeros_of_either_sign_make_equal_vectors(frame):
    rows = [(k, [0.0 if k % 2 else -0.0, 1.0 + k // 20]) for k in range(60)]
    assert run(frame, rows) == exact(rows, 10)
