from __future__ import annotations

import random
import re
from collections import Counter

from compare import connect, differences

from depotflow.llm.divergence import divergences, share, term_counts, terms, tree_nodes
from depotflow.llm.queries import ORACLE, op13_source_divergence

DOCS = "text string, lang string, source string, value string, rank long, path string"


def by_hand(rows, least, top):
    """Every pair of groups over every kept term, with Python's whole numbers."""
    words = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), g or "", s or "") for t, g, s, *_ in rows]
    out = set()
    for lang in {g for _, g, _ in words}:
        held = Counter(w for ws, g, _ in words if g == lang for w in set(ws))
        kept = sorted(w for w, n in held.items() if n >= least)
        count = {}
        for ws, g, s in words:
            if g == lang:
                count.setdefault(s, Counter()).update(w for w in ws if w in set(kept))
        count_all = sum(count.values(), Counter())

        def shares(c):
            n = sum(c.values())
            return {w: 1 + 1_000_000_000 * (c[w] + 2) // (n + 2 * len(kept)) for w in kept}

        p = {s: shares(c) for s, c in count.items()}
        q = shares(count_all)
        f = lambda x, y: (x - y) * (x - y) // (x + y)
        for s in p:
            found = {
                "pair": {h: sum(f(p[s][w], p[h][w]) for w in kept) for h in p if h != s},
                "term": {w: f(p[s][w], q[w]) for w in kept if count[s][w] and p[s][w] > q[w]},
            }
            for part, values in found.items():
                ranked = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(ranked) if part == "pair" or k < top}
    return out


def some_rows(n, seed):
    rng = random.Random(seed)
    vocab = ["Ab", "b", "ünï", "中文", "x1y", "the", "İ", "Ωm", "z-z", "e"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = []
    for _ in range(n):
        text = rng.choice([None, "", "123 !", *[" ".join(rng.choices(vocab, k=rng.randint(1, 40))) for _ in range(6)]])
        rows.append((text, rng.choice([None, "", "en", "en", "de"]), rng.choice([None, "a", "b", "b", "c", "d"]), "own", 7, "p"))
    return rows


def test_equal_to_all_pairs_by_hand(frame):
    rows = some_rows(150, 1)
    rows += [("   ", "fr", "a", "", 1, ""), (None, "fr", "b", "", 1, ""), ("once", "it", "only", "", 1, "")]
    got = {tuple(r) for r in divergences(frame(DOCS, rows)).collect()}
    assert got == by_hand(rows, 10, 10)
    assert {tuple(r) for r in divergences(frame(DOCS, rows), least_docs=1, top=3).collect()} == by_hand(rows, 1, 3)


def test_empty_table_and_one_group(frame):
    assert divergences(frame(DOCS, [])).count() == 0
    rows = [("same words", "en", "a", "", 1, "")] * 12
    assert {tuple(r) for r in divergences(frame(DOCS, rows)).collect()} == by_hand(rows, 10, 10) == set()


def test_a_very_long_text_and_a_hot_group(frame):
    rows = [("long " * 200_000, "en", "a", "", 1, "")] + [("long short", "en", "a", "", 1, "")] * 500 + [("other short", "en", "b", "", 1, "")] * 20
    assert {tuple(r) for r in divergences(frame(DOCS, rows)).collect()} == by_hand(rows, 10, 10)


def test_rows_with_one_beginning_share_nodes(frame):
    a, b, c = ("a", 1), ("b", 2), ("c", 1)
    rows = [("en", [a, b])] * 5 + [("en", [a, b, c])] * 2 + [("en", [a])] + [("de", [a])]
    made = tree_nodes(frame("lang string, path array<struct<source string, n long>>", rows)).collect()
    assert {(r["lang"], tuple(map(tuple, r["path"])), r["m"]) for r in made} == {
        ("en", (a,), 8), ("en", (a, b), 7), ("en", (a, b, c), 2), ("de", (a,), 1),
    }


def test_counts_beyond_a_long_stay_exact(spark):
    big = 90_000_000_000
    row = spark.range(1).selectExpr(f"{big}L AS c", f"{3 * big}L AS n", "5L AS v").select(share("c", "n", "v").alias("p")).first()
    assert row["p"] == 1 + 1_000_000_000 * (big + 2) // (3 * big + 10)


def test_terms_and_their_counts(frame):
    assert terms("Straße ÄÖ x_y it's".encode()) == [b"stra\xc3\x9fe", "ÄÖ".encode(), b"x", b"y", b"it", b"s"]
    got = {tuple(r) for r in term_counts(frame(DOCS, [("a A b", "en", None, "", 1, ""), ("a", "en", "", "", 1, "")])).collect()}
    assert got == {("en", "", "a", 3, 2), ("en", "", "b", 1, 1)}


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert not differences(op13_source_divergence(spark, folder), connect(folder), ORACLE["op13_source_divergence"])
