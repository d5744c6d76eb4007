from __future__ import annotations

import random
import re

from depotflow.llm.decontaminate import contaminated, remove_contaminated

SCHEMA, BENCH = "doc_id long, text string, coverage string", "item_id long, text string, doc_id string"
ITEM = "On Monday a farmer named Alice sold 12 kg of apples and 3.5 kg of pears to Bob, then Alice kept 12 coins for the next day."


def found(frame, docs, items):
    rows = contaminated(frame(SCHEMA, [(*d, "own") for d in docs]), frame(BENCH, [(*b, "own") for b in items])).collect()
    return {(r["doc_id"], r["item_id"]): r for r in rows}


def test_other_numbers_and_names_are_caught_if_they_are_consistent(frame):
    changed = ITEM.replace("Alice", "Carla").replace("Bob", "Dan").replace("12", "77").replace("3.5", "9.1")
    torn = ITEM.replace("named Alice", "named Carla").replace("then Alice", "then Maria").replace("12 kg", "77 kg").replace("12 coins", "80 coins")
    merged = ITEM.replace("Alice", "Carla").replace("Bob", "Carla")
    docs = [(1, "so it goes. " + ITEM + " And on."), (2, changed), (3, torn), (4, merged), (5, ITEM.upper()), (6, ITEM[:60]), (7, None), (8, "")]
    got = found(frame, docs, [(50, ITEM), (51, None), (52, "")])
    assert set(got) == {(1, 50), (2, 50)}
    assert got[1, 50]["n_changed"] == 0 and got[2, 50]["n_changed"] == 7 and got[2, 50]["n_slots"] == 10  # a day's name and two units stay


def test_passages_are_found_like_by_brute_force(frame):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 8)))
    items = [(k, " ".join(word() for _ in range(rnd.randrange(20, 40)))) for k in range(15)]
    docs = []
    for k in range(120):
        text = [word() for _ in range(rnd.randrange(0, 150))]
        if k % 3 == 0:
            part = items[rnd.randrange(15)][1].split()
            part = part[: rnd.choice([len(part), len(part), len(part) // 2])]
            at = rnd.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((k, ", ".join(text).capitalize() + "."))
    docs += [(k + 1000, docs[k][1]) for k in range(0, 30, 3)] + docs[:4]

    def windows(text):
        words = re.findall(r"\w+", text.lower())
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    expected = {(i, k) for i, t in docs for k, b in items if len(windows(t) & windows(b)) >= 0.8 * len(windows(b))}
    assert expected and set(found(frame, docs, items)) == expected


def test_short_items_only_match_whole_texts(frame):
    assert set(found(frame, [(1, "What now?"), (2, "so what now then")], [(9, "what now")])) == {(1, 9)}


def test_removal_keeps_columns_nulls_and_repeats(frame):
    docs = frame(SCHEMA, [(1, ITEM, "a"), (2, "clean words of my own here", "b"), (2, "clean words of my own here", "b"), (None, ITEM, "c"), (4, None, "d")])
    kept = remove_contaminated(docs, frame(BENCH, [(7, ITEM, "x")]))
    assert kept.columns == docs.columns and sorted(r["coverage"] for r in kept.collect()) == ["b", "b", "c", "d"]
    assert remove_contaminated(docs, frame(BENCH, [])).count() == 5
    assert contaminated(docs.limit(0), frame(BENCH, [(7, ITEM, "x")])).count() == 0


def test_shuffled_join_gives_the_same(frame, monkeypatch):
    from depotflow.llm import decontaminate

    docs, items = [(1, "x " + ITEM)], [(3, ITEM)]
    small = set(found(frame, docs, items))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert set(found(frame, docs, items)) == small == {(1, 3)}
