"""Cheapest repair of damaged conversations by weighted CYK parsing.

A sound conversation has the role initials (s?(ua)+)?. Its grammar in Chomsky normal form has a nonterminal for each pair of states
(p, q) of the automaton of that language, "this span takes p to q", and the rules (p, q) -> (p, r) (r, q). The edits of one row are the
terminal rules; a cell is closed under insertion on both sides of its row. A cell holds for each nonterminal the smallest (cost, audit),
where the audit has one letter for each edit: K keep, R rerole, D delete, I insert. Spans are combined bottom-up by their length. As the
rules split a span at any place alike, each span of 2, 4, 8, ... rows is parsed at one split, which gives the same cell as all
splits: n rows cost about n combinations. Of equal cost, no audit begins with another one (a longer one has more insertions), so the
smallest audits of two halves make the smallest of the whole.

Nulls: a null role or text is one space, a null id groups its rows like any other id, null turns come first. Rows with the same turn are
taken in the order of role and text. A role whose initial is not s, u or a can't be kept. Empty texts are blank. Other columns
are not read. An empty table gives an empty result. A conversation is one row for the hash of its whole text, so it must fit into a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from depotflow.llm.common import reach_package

# Fixed values of the contract.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANKS, STOPS = " \t\n\x0b\x0c\r", ".!?"
NAMES = {"u": "user", "a": "assistant"}
# The automaton of (s?(ua)+)?: nothing read, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
FINAL = (START, ASSISTANT)
MADE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

Cell = dict[tuple[int, int], tuple[int, str]]


def combine(left: Cell, right: Cell) -> Cell:
    """Cell of two adjoining spans: the smallest (cost, audit) of every rule (p, q) -> (p, r) (r, q)."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (s, q), (more, rest) in right.items():
            if r == s:
                way = (cost + more, audit + rest)
                if (p, q) not in out or way < out[p, q]:
                    out[p, q] = way
    return out


def _insertions() -> Cell:
    """Every move that insertions alone can make, by the fewest."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    one: Cell = {(p, q): (INSERT, "I") for (p, initial), q in MOVES.items() if initial in NAMES}
    for _ in range(4):
        for pair, way in combine(cell, one).items():
            cell[pair] = min(way, cell.get(pair, way))
    return cell


INSERTIONS = _insertions()


@lru_cache(64)
def _leaf(initial: str, must_go: bool, cut: bool) -> tuple[tuple[tuple[int, int], tuple[int, str]], ...]:
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if not must_go:
        for (p, wanted), q in MOVES.items():
            if wanted == initial:
                cell[p, q] = min((KEEP + TRUNCATED * cut, "K"), cell.get((p, q), (99, "")))
            elif wanted in NAMES:
                cell[p, q] = min((REROLE + TRUNCATED * cut, "R"), cell.get((p, q), (99, "")))
    return tuple(combine(combine(INSERTIONS, cell), INSERTIONS).items())


def parse(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Smallest (cost, audit) for rows given as (initial, must go, truncated); initials other than s, u, a are "" or any letter."""
    if not rows:
        return 0, ""
    cells = [dict(_leaf(initial if initial in ("s", "u", "a") else "", gone, cut)) for initial, gone, cut in rows]
    while len(cells) > 1:  # spans of twice the length
        cells = [combine(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return min(cells[0][START, q] for q in FINAL if (START, q) in cells[0])


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each (role, text): blank, duplicate, truncated or none."""
    seen: set[tuple[str, str]] = set()
    found = []
    for role, text in rows:
        words = text.strip(BLANKS)
        found.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in STOPS else "")
        seen.add((role, text))
    return found


def apply_audit(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The rows after the edits of an audit. New roles follow from what comes before them."""
    state, at, out = START, 0, []
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = NAMES["a" if state == USER else "u"]
        out.append((role, text))
        state = MOVES[state, role[:1]]
    return out


def _report(turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    found = faults(rows)
    numbers = [t for t in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [role[:1] for role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = parse([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, found)])
    text = "\n".join(f"{role}:{text}" for role, text in apply_audit(rows, audit))
    return gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def damaged(conv_id: Column, turn: Column, role: Column, text: Column) -> Column:
    """The row after its damage, as an array of none, one or two (turn, role, text); the damage follows from its id and turn."""

    def blank(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(blank(conv_id), F.lit(":"), blank(turn)).cast("binary")) % 20
    row = F.struct(
        turn.cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(blank(role)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank(text), "[.!?]", "")).otherwise(blank(text)).alias("text"),
    )
    return F.array_repeat(row, F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))


def repair(turns: DataFrame) -> DataFrame:
    """One row for each conv_id of (conv_id, rows: array of (turn, role, text)): faults, the cheapest repair and its digest."""
    reach_package(turns.sparkSession)
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.flatten(F.collect_list("rows"))).alias("rows"))
    flat = grouped.select("conv_id", "rows.turn", "rows.role", "rows.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for k in range(batch.num_rows):
                numbers, roles, texts = (batch.column(c)[k].as_py() for c in (1, 2, 3))
                made.append(_report(numbers, list(zip(roles, texts))))
            columns = list(zip(*made)) if made else [[]] * 8
            types = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]],
                ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
            )

    return flat.mapInArrow(run, MADE)


def damage_and_repair(turns: DataFrame) -> DataFrame:
    """`repair` of a table of (conv_id, turn, role, text) after its damage; every id of the table is in the result."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), damaged(*[F.col(c) for c in ("conv_id", "turn", "role", "text")]).alias("rows"))
    return repair(rows)
