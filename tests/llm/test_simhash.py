from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from depotflow.llm import simhash
from depotflow.llm.components import components
from depotflow.llm.simhash import links, segment_pairs, shingle_hashes, similar_groups, simhash_groups, xxh64

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def shingles(text: str | None, n: int) -> list[str]:
    words = SPACE.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])


def fingerprint(text: str | None, n: int = 3) -> int:
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, n)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(nodes, linked) -> dict:
    at = {n: n for n in nodes}

    def find(n):
        while at[n] != n:
            n = at[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                at[y] = x
    return {n: find(n) for n in nodes}


def test_hashes_are_those_of_the_library():
    rnd = random.Random(1)
    data = np.frombuffer(rnd.randbytes(900) + b"\0" * 8, np.uint8)
    starts = np.array([rnd.randrange(600) for _ in range(400)])
    sizes = np.array([rnd.randrange(0, 150) for _ in range(400)])
    expected = [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(starts, sizes)]
    assert xxh64(data, starts, sizes).tolist() == expected


def test_shingles_by_hand():
    texts = ["", " \t\n", "One", "a b", "A b  c\nd", "é ß x y z " * 30]
    hashes, counts = shingle_hashes([t.encode() for t in texts], 3)
    expected = [[xxhash.xxh64_intdigest(s, 42) for s in shingles(t, 3)] for t in texts]
    assert counts.tolist() == [len(x) for x in expected]
    assert hashes.tolist() == [h for x in expected for h in x]


def test_groups_equal_brute_force(spark, frame):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(1, 9))) for _ in range(120)]
    texts += [t.upper() for t in texts[:10]] + ["", None, "  ", "x", "x"]
    got = {r["doc_id"]: r for r in simhash_groups(frame("doc_id long, text string", list(enumerate(texts)))).collect()}
    prints = [fingerprint(t) for t in texts]
    expected = groups(range(len(texts)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]


def test_links_connect_what_two_bits_connect(spark, frame):
    rnd = random.Random(9)
    prints = [rnd.getrandbits(64) for _ in range(8)]
    for p in list(prints):
        for _ in range(12):
            p ^= 1 << rnd.randrange(64)
            p ^= (1 << rnd.randrange(64)) if rnd.random() < 0.6 else 0
            prints.append(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints] + [-1, -1 << 63, 0, 3]
    for bits in (0, 1, 2):
        found = components(links(frame("fingerprint long", [(p,) for p in signed]), bits)).collect()
        label = {p: p for p in signed} | {r["node"]: r["label"] for r in found}
        mask = (1 << 64) - 1
        expected = groups(sorted(set(signed)), lambda a, b, bits=bits: ((a ^ b) & mask).bit_count() <= bits)
        assert label == expected, bits


def test_long_chains_and_large_stars(frame):
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, k) for k in range(1001, 1400)]
    got = {r["node"]: r["label"] for r in components(frame("src long, dst long", chain + star + [(7, 7), (3, 2)])).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1400)}
    assert components(frame("src long, dst long", [])).count() == 0


def test_similar_groups_find_all_near_copies(frame):
    rnd = random.Random(3)

    def prose(n):
        return ["".join(rnd.choices("aeioutnrs", k=rnd.randrange(2, 9))) for _ in range(n)]

    rows, truth = [], defaultdict(set)
    for g in range(40):
        base = prose(rnd.randrange(80, 400))
        for _ in range(4):
            copy = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 60)):
                copy[rnd.randrange(len(copy))] = "".join(rnd.choices("xyz", k=6))
            truth[g].add(len(rows))
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, "one two", "one two"])]
    sets = {i: set(shingles(t, 5)) for i, t in rows}
    near = lambda a, b: (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    expected = groups([i for i, _ in rows], near)
    got = {r["doc_id"]: r["component_id"] for r in similar_groups(frame("doc_id long, text string", rows)).collect()}
    together = [(a, b) for a in got for b in got if a < b and expected[a] == expected[b]]
    assert sum(got[a] == got[b] for a, b in together) >= 0.98 * len(together)
    assert all(expected[a] == expected[b] for a in got for b in got if got[a] == got[b])


def prose(rnd, n):
    return ["".join(rnd.choices("aeioutnrs", k=rnd.randrange(2, 9))) for _ in range(n)]


def similar(frame, texts):
    return {r["doc_id"]: r["component_id"] for r in similar_groups(frame("doc_id long, text string", list(enumerate(texts)))).collect()}


def expected_groups(texts):
    sets = [set(shingles(t, 5)) for t in texts]
    return groups(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def test_similar_groups_join_copies_that_are_only_like_their_original(frame):
    """Copies at the threshold to their original and below it to each other: mostly a copy is the first member of the keys."""
    rnd, texts = random.Random(11), []
    for _ in range(20):
        base = prose(rnd, rnd.randrange(150, 400))
        texts.append(" ".join(base))
        for _ in range(5):
            copy = list(base)
            for at in rnd.sample(range(5, len(base) - 5), len(base) // 46):
                copy[at] = "".join(rnd.choices("xyz", k=6))
            texts.append(" ".join(copy))
    assert similar(frame, texts) == expected_groups(texts)


def test_similar_groups_find_copies_cut_or_extended_at_the_end(frame):
    rnd, texts = random.Random(12), []
    for k in range(120):
        base = prose(rnd, rnd.randrange(60, 400))
        extent = 0.05 + 0.15 * k / 119
        texts.append(" ".join(base))
        texts.append(" ".join(base[: round(len(base) * (1 - extent))] if k % 2 else base + prose(rnd, round(len(base) * extent))))
    assert similar(frame, texts) == expected_groups(texts)


def test_a_key_with_many_unlike_members_joins_few_rows(spark, frame):
    """500 sets of sizes from 20 to 5,000 that share one rare key: sizes and positions leave few of the 125,000 pairs."""
    from depotflow.llm.simhash import close_members

    rnd = random.Random(6)
    rows = []
    for node in range(500):
        n = int(20 * 250 ** rnd.random())
        rows.append((1, node, n, rnd.randrange(max(1, n // 5)), node))
    found = {(r["src"], r["dst"]) for r in close_members(frame("key long, node long, n long, pos int, label long", rows), 0.8).collect()}
    n, pos = {r[1]: r[2] for r in rows}, {r[1]: r[3] for r in rows}
    may = lambda a, b: (
        min(n[a], n[b]) >= 0.8 * max(n[a], n[b]) and 1 + min(n[a] - pos[a] - 1, n[b] - pos[b] - 1) >= 0.8 / 1.8 * (n[a] + n[b]) - 1e-6
    )
    assert found == {(a, b) for a in range(500) for b in range(a + 1, 500) if may(a, b)}
    assert len(found) < 125_000 / 10
    assert close_members(frame("key long, node long, n long, pos int, label long", [(1, k, 100, 0, 9) for k in range(50)]), 0.8).count() == 0


def test_pairs_meet_at_the_first_of_many_common_keys(frame):
    """60 sets that share 90 keys in various orders of subsets: every pair is found, and the join makes hardly more rows than pairs."""
    from depotflow.llm.simhash import close_members

    rnd, rows = random.Random(9), []
    for node in range(60):
        keys = [k for k in range(100) if rnd.random() < 0.9]
        rows += [(k, node, 1000, pos, node) for pos, k in enumerate(keys)]
    met = close_members(frame("key long, node long, n long, pos int, label long", rows), 0.8)
    assert {(r["src"], r["dst"]) for r in met.collect()} == {(a, b) for a in range(60) for b in range(a + 1, 60)}
    made = [int(m.value()) for m in join_metrics(met)]
    assert len(made) == 1 and 1770 <= made[0] <= 3000


def test_pairs_of_random_keys_are_those_of_a_plain_join(frame):
    from depotflow.llm.simhash import close_members

    rnd, rows = random.Random(10), []
    for node in range(80):
        n = rnd.randrange(20, 200)
        keys = rnd.sample(range(150), rnd.randrange(1, n // 5 + 2))  # each in an order of its own
        rows += [(k, node, n, pos, node // 3) for pos, k in enumerate(keys)]
    found = {(r["src"], r["dst"]) for r in close_members(frame("key long, node long, n long, pos int, label long", rows), 0.8).collect()}
    plain = {
        (a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[4] != b[4] and min(a[2], b[2]) >= 0.8 * max(a[2], b[2]) - 1e-6
        and 1 + min(a[2] - a[3] - 1, b[2] - b[3] - 1) >= np.ceil(0.8 / 1.8 * (a[2] + b[2]) - 1e-6)
    }
    assert found == plain and len(plain) > 100


def join_metrics(df):
    """Numbers of rows that the inner joins of a collected query made."""
    plans, found = [df._jdf.queryExecution().executedPlan()], []
    while plans:
        plan = plans.pop()
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            plans.append(plan.executedPlan())
            continue
        if "QueryStage" in name:
            plans.append(plan.plan())
            continue
        if "Join" in name:
            found.append(plan.metrics().apply("numOutputRows"))
        children = plan.children()
        plans += [children.apply(k) for k in range(children.size())]
    return found


def test_segment_tables_find_pairs_within_three_bits(frame):
    rnd = random.Random(21)
    rows, mask = [], (1 << 64) - 1
    for k in range(60):
        p = rnd.getrandbits(64)
        q = p
        for b in rnd.sample(range(64), k % 6):
            q ^= 1 << b
        rows += [(2 * k, 100, p), (2 * k + 1, 100, q)]
    rows.append((1000, 5, rows[0][2]))  # the same fingerprint, but of a size that rules the pair out
    signed = [(i, n, p - (1 << 64) if p >> 63 else p) for i, n, p in rows]
    found = {(r["src"], r["dst"]) for r in segment_pairs(frame("node long, n long, fingerprint long", signed), 0.8).collect()}
    half = lambda x: min((x & 0xFFFFFFFF).bit_count(), (x >> 32).bit_count())
    expected = {(2 * k, 2 * k + 1) for k in range(60) if half((rows[2 * k][2] ^ rows[2 * k + 1][2]) & mask) <= 1}
    assert expected >= {(2 * k, 2 * k + 1) for k in range(60) if k % 6 <= 3}
    assert {(min(a, b), max(a, b)) for a, b in found} == expected


def test_near_copies_come_through_the_segment_tables(frame, monkeypatch):
    """Copies whose fingerprints the balls cover are classed without any pair from the join on prefixes."""
    rnd, texts = random.Random(22), []
    for _ in range(12):
        base = prose(rnd, 300)
        texts += [" ".join(base), " ".join([*base, "tail"]), " ".join(["head", *base])]
    expected, prints = expected_groups(texts), [fingerprint(t, 5) for t in texts]
    covered = [
        i % 3 == 0 or min(((prints[i] ^ prints[i - i % 3]) >> s & 0xFFFFFFFF).bit_count() for s in (0, 32)) <= 1 for i in range(len(texts))
    ]
    assert sum(covered) >= 30
    monkeypatch.setattr(simhash, "HUB_ROUNDS", 0)
    monkeypatch.setattr(simhash, "prefix_sizes", lambda counts, similarity: np.zeros(len(counts), np.int64))
    got = similar(frame, texts)
    # a value yields its smallest node, so two texts may also be held together by the third one of their group
    assert sum(got[i] == expected[i] for i in got) >= sum(covered) - 3
    assert all(expected[i] == expected[got[i]] for i in got)


def test_wide_bitmaps_never_differ_more_than_the_sets(frame):
    """Of sets of any sizes; for long ones that have little in common they differ more than similar sets could."""
    rnd, rows, truth = random.Random(31), [], []
    for k in range(60):
        n, m = int(1030 * 8 ** rnd.random()), 0
        m = int(n * (0.8 + 0.2 * rnd.random()))
        a = {rnd.getrandbits(64) for _ in range(n)}
        b = set(rnd.sample(sorted(a), int(m * (0.3 if k % 2 else 0.97))))
        b |= {rnd.getrandbits(64) for _ in range(m - len(b))}
        maps = []
        for x in (a, b):
            counts = np.array([len(x)])
            maps.append(simhash._parity_maps(np.array(sorted(x), np.uint64), counts, simhash.wide_words(counts)).view(np.int64).tolist())
        rows.append((k, *maps))
        truth.append((len(a ^ b), (len(a) + len(b)) / 9))
    assert {len(r[1]) == len(r[2]) for r in rows} >= {False, True}
    found = frame("k int, a array<long>, b array<long>", rows).select("k", simhash._bits_apart("a", "b").alias("bits")).collect()
    for r in found:
        apart, bound = truth[r["k"]]
        # a set of 1,024 elements or fewer has no wide bitmap
        assert r["bits"] is None or r["bits"] <= apart and (r["k"] % 2 == 0 or r["bits"] > bound), r
    assert sum(r["bits"] is not None for r in found) > 50


def test_long_texts_with_common_passages_are_not_fetched(frame, monkeypatch):
    """Their sets share many rare keys, but only the sets of the two near copies are made to be compared."""
    rnd = random.Random(32)
    texts = [" ".join(passage + prose(rnd, 2800)) for passage in [prose(rnd, 1800) for _ in range(3)] for _ in range(2)]
    base = prose(rnd, 4000)
    texts += [" ".join(base), " ".join([*base, "tail"])]
    fetched, plain = [], simhash.stage

    def spied(df):
        out = plain(df)
        if "set" in out.columns:
            fetched.extend(r["node"] for r in out.select("node").collect())
        return out

    monkeypatch.setattr(simhash, "stage", spied)
    assert similar(frame, texts) == expected_groups(texts)
    assert len(set(fetched)) <= 2
