from __future__ import annotations

import random

from depotflow.llm.shards import assign_shards, longest_first, write_shards


def loads(rows, shards):
    size, count = [0] * shards, [0] * shards
    for r in rows:
        size[r["shard"]] += r["size"]
        count[r["shard"]] += 1
    return size, count


def test_heap_takes_the_longest_first():
    placed = dict((item, shard) for _, item, shard in longest_first([(0, k, s) for k, s in enumerate([7, 6, 5, 4, 3])], 2))
    assert placed == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0} or placed == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1}


def test_sizes_are_near_equal_and_equal_texts_stay_together(frame):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices("abc ", k=rnd.randrange(0, 400))) for _ in range(900)] + ["hot text"] * 300 + ["", None, ""]
    rows = assign_shards(frame("doc_id long, text string, shard string", [(i, t, "own") for i, t in enumerate(texts)]), 5).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    size, _ = loads(rows, 5)
    assert max(size) - min(size) <= 8
    where = {}
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 8
        assert where.setdefault(r["text"] or "", r["shard"]) == r["shard"]
    for k in range(5):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_bundles_bound_what_the_heap_sees(frame, monkeypatch):
    from depotflow.llm import shards

    seen = []
    monkeypatch.setattr(shards, "longest_first", lambda items, n, real=longest_first: seen.append(len(items)) or real(items, n))
    rnd = random.Random(2)
    rows = assign_shards(frame("doc_id long, text string", [(i, "x" * rnd.randrange(50) + str(i)) for i in range(3000)]), 4, bundles=64).collect()
    assert seen[0] <= 128
    size, _ = loads(rows, 4)
    assert max(size) - min(size) < 0.03 * sum(size) / 4


def test_a_group_larger_than_a_shard_and_an_empty_table(frame):
    rows = assign_shards(frame("doc_id long, text string", [(i, "big" * 100) for i in range(50)] + [(99, "a"), (None, "b")]), 3).collect()
    assert len({r["shard"] for r in rows if r["text"] and len(r["text"]) > 1}) == 1
    assert {r["shard"] for r in rows} == {0, 1, 2}
    assert assign_shards(frame("doc_id long, text string", []), 3).count() == 0


def test_written_shards_read_back(spark, frame, tmp_path):
    rows = assign_shards(frame("doc_id long, text string", [(i, str(i) * 3) for i in range(200)]), 4)
    write_shards(rows, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").select(rows.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
