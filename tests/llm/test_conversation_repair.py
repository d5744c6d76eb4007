from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import pytest
from compare import connect, differences

from depotflow.llm.conversation_repair import apply_audit, damage_and_repair, faults, parse
from depotflow.llm.queries import ORACLE, op12_conversation_repair

TURNS = "conv_id long, turn long, role string, text string, cost string, audit long"
SOUND = {"": True}


def is_sound(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (rest != "" and len(rest) % 2 == 0 and all(c == "ua"[k % 2] for k, c in enumerate(rest)))


def cheapest(rows):
    """Every sequence of edits with up to n + 2 insertions, tried one by one."""
    best = None
    places = len(rows) + 1
    for inserted in itertools.product(("", "u", "a", "ua", "au"), repeat=places):
        options = []
        for initial, gone, cut in rows:
            one = [("D", "", 3)]
            if not gone:
                one += [("K", initial or "?", int(cut)), ("R", "u", 2 + cut), ("R", "a", 2 + cut)]
            options.append(one)
        for chosen in itertools.product(*options):
            initials, audit, cost = "", "", 0
            for k in range(places):
                initials += inserted[k]
                audit += "I" * len(inserted[k])
                cost += 2 * len(inserted[k])
                if k < len(rows):
                    letter, made, price = chosen[k]
                    initials, audit, cost = initials + made, audit + letter, cost + price
            if is_sound(initials) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


@pytest.mark.parametrize("n", range(4))
def test_cheapest_of_all_edits(n):
    kinds = [(i, g, c) for i in ("s", "u", "a", "") for g, c in ((False, False), (True, False), (False, True))]
    every = list(itertools.product(kinds, repeat=n))
    for rows in every if n < 3 else random.Random(1).sample(every, 25):
        assert parse(list(rows)) == (cheapest(rows) if rows else (0, "")), rows


def stepwise(rows):
    """The automaton row by row, without spans."""
    inserts = {(0, 2): "I", (1, 2): "I", (3, 2): "I", (2, 3): "I", (0, 3): "II", (1, 3): "II"} | {(p, p): "" for p in range(4)}
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    at = {0: (0, "")}

    def insert(states):
        out = {}
        for p, (cost, audit) in states.items():
            for (a, q), more in inserts.items():
                if a == p:
                    out[q] = min(out.get(q, (10**9, "")), (cost + 2 * len(more), audit + more))
        return out

    for initial, gone, cut in rows:
        out = {}
        for p, (cost, audit) in insert(at).items():
            ways = [(p, 3, "D")]
            if not gone:
                ways += [(moves[p, initial], cut, "K")] if (p, initial) in moves else []
                ways += [(moves[p, to], 2 + cut, "R") for to in "ua" if (p, to) in moves]
            for q, price, letter in ways:
                out[q] = min(out.get(q, (10**9, "")), (cost + price, audit + letter))
        at = out
    return min(way for q, way in insert(at).items() if q in (0, 3))


def test_long_conversations_equal_a_walk_row_by_row():
    rng = random.Random(2)
    for n in [*range(1, 40), 257, 3000]:
        rows = [(rng.choice("suaua"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(n)]
        assert parse(rows) == stepwise(rows)


def test_faults_and_edits():
    rows = [("user", "Hi."), ("user", " \t"), ("assistant", "Yes"), ("user", "Hi."), ("x", "ok? \n")]
    assert faults(rows) == ["", "blank", "truncated", "duplicate", ""]
    assert apply_audit(rows, "KDKDI" + "R") == [("user", "Hi."), ("assistant", "Yes"), ("user", ""), ("assistant", "ok? \n")]


def test_nulls_ties_and_conversations_without_rows(frame):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [
        (gone, 0, "user", "Gone."), (None, None, None, None), (None, 3, "user", "A."), (None, 3, "assistant", "B."), (None, 9, "user", ""),
        (2000, None, "tool", "x."), (2000, None, "tool", "x."),
    ]
    got = {r["conv_id"]: r for r in damage_and_repair(frame(TURNS, [(*r, "own", 1) for r in rows])).collect()}
    assert set(got) == {gone, None, 2000}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2000]["gaps"] == 0
    assert damage_and_repair(frame(TURNS, [])).count() == 0


def test_query_and_own_rows_equal_the_sql(spark, frame, tmp_path):
    con = connect("/root/testdata/sf0.01")
    assert not differences(op12_conversation_repair(spark, "/root/testdata/sf0.01"), con, ORACLE["op12_conversation_repair"])
    rng = random.Random(4)
    rows = [
        (rng.choice([None, *range(40)]), rng.choice([None, *range(6)]), rng.choice([None, "user", "assistant", "system", "tool", "", "user"]),
         rng.choice([None, "", " ", "a.", "b", "é!", "a\nb?", "\x0b", "same."]))
        for _ in range(600)
    ]
    frame("conv_id long, turn long, role string, text string", rows).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert not differences(op12_conversation_repair(spark, str(tmp_path)), con, ORACLE["op12_conversation_repair"])
