from __future__ import annotations

import hashlib

import duckdb

from depotflow.llm.chat import digests, format_chats, read_turns
from depotflow.llm.queries import ORACLE, op5_chat_format

SCHEMA = "conv_id long, turn long, role string, text string, n_turns string"


def by_hand(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "user", "hi <end>\n<turn>assistant<says>no"), (1, 1, "assistant", "\\b\\l \\\\l <b> é🙂"), (1, 2, "assistant", ""), (1, 3, "assistant", "more"),
    (1, 5, "user", None), (1, 4, None, "who"), (2, 1, "assistant", "x"), (2, 1, "assistant", "x"), (2, 0, "sys<tem>", "a"), (2, None, "user", "first"),
    (3, 0, "user", ""), (None, 0, "assistant", "lost"), (None, 1, "user", "<and>"),
]


def test_everything_is_read_back(frame):
    chats = format_chats(frame(SCHEMA, [(*r, "own") for r in ROWS]))
    got = {r["conv_id"]: tuple(r)[1:5] for r in digests(chats).collect()}
    assert got == by_hand(ROWS)


def test_neighbours_of_one_role_share_a_block_and_the_mask_covers_only_text(frame):
    chats = {r["conv_id"]: r for r in format_chats(frame(SCHEMA, [(*r, "own") for r in ROWS])).collect()}
    assert chats[2]["formatted"] == "<turn>user<says>first<end>\n<turn>sys\\ltem><says>a<end>\n<turn>assistant<says>x<and>x<end>\n"
    text = chats[1]["formatted"]
    assert [text[s["start"] : s["stop"]] for s in chats[1]["loss"]] == ["\\bb\\bl \\b\\bl \\lb> é🙂", "", "more"]


def test_a_long_conversation(frame):
    rows = [(9, k, ("user", "assistant", "assistant")[k % 3], f"text {k} <") for k in range(3000)]
    chats = format_chats(frame(SCHEMA, [(*r, "") for r in rows]))
    assert {r["conv_id"]: tuple(r)[1:5] for r in digests(chats).collect()} == by_hand(rows)
    assert read_turns(chats).filter("learned").count() == 2000
    assert digests(format_chats(frame(SCHEMA, []))).count() == 0


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    got = op5_chat_format(spark, folder)
    cursor = db.execute(ORACLE["op5_chat_format"])
    names = [c[0] for c in cursor.description]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(cursor.fetchall())
