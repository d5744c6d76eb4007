from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from depotflow.llm.token_files import BATCH_SEQUENCES, Encoder, read_documents, read_sequence, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


TRICKY = [
    "", " ", "\n\n", "The end.", "don't can't we'll 'tis", "a  b\tc d　e", "Größe ÉTÉ ﬁn été", "# ## #", "123 4,5.6", "x<|endoftext|>y",
    "THE!! of%%% |", "Ünïcödé 日本語 한국어 🙂🙂", "end.,", "...", "A.B", "İstanbul ΣΑΣ ς", "a\x00b", "\x85next\x1cline",
]


def test_pieces_give_the_ids_of_whole_texts(library):
    rnd = random.Random(3)
    texts = TRICKY + [" ".join(rnd.choices(TRICKY, k=6)) for _ in range(200)]
    coder = Encoder(PATH)
    for _ in range(2):  # the second time from memory
        ids, counts = coder.encode([t.encode() for t in texts])
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for text, part in zip(texts, parts):
            assert part.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_case_and_closing_marks_make_no_new_pieces_where_ids_stay(library, monkeypatch):
    coder = Encoder(PATH)
    coder.encode([b"Stock, stock. STOCK!!! stock %% stock"])
    assert set(coder.number) == {"stock", ",", ".", "!!!", "%%"}
    # small letters with these marks have a sign of their own, and special tokens are told by case
    texts = ["H\u0331 T\u0308 W\u030a Y\u030a J\u030c h\u0331, Stop, <|ENDOFTEXT|>, <|endoftext|> Stop", "Fin\u00e9e!!, \u00dcber: \u00f7, \u00d7. I\u0307. \u00ad, a\u00ad, \u00ff. \u00df?"]
    monkeypatch.setattr("depotflow.llm.token_files.CACHE_PIECES", 8)
    for n in range(12):  # pieces are forgotten and learned again
        more = [*texts, *(f"w{k} common, word{chr(97 + k)}{n}" for k in range(n % 5 * 3))]
        ids, counts = coder.encode([t.encode() for t in more])
        for text, part in zip(more, np.split(ids, np.cumsum(counts)[:-1])):
            assert part.tolist() == library.encode(text, add_special_tokens=False).ids, text
    coder._forget()
    assert len(coder.number) == 4 and all(coder.seen[k] >= 0 for k in coder.number.values())


def test_files_hold_every_document_in_order(spark, frame, library):
    rnd = random.Random(7)
    texts = [" ".join(rnd.choices(["alpha", "Beta,", "γ", "don't", "12", "#"], k=rnd.randrange(0, 120))) for _ in range(150)] + TRICKY + [None]
    ids = rnd.sample(range(10_000), len(texts))
    rows = frame("doc_id long, n_tokens int, text string", [(i, 1, t) for i, t in zip(ids, texts)])
    manifest = write_tokens(rows, PATH, 2, length=32)
    got = {r["doc_id"]: r for r in read_documents(manifest).collect()}
    at, stream = 0, []
    for i, text in sorted(zip(ids, texts)):
        own = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert tuple(got[i])[:4] == (i, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
        stream.append(own)
    # random access: sequences of each file, cut at their masks, are the stream again
    back = []
    for row in sorted(manifest.collect(), key=lambda r: r["shard"]):
        order = rnd.sample(range(row["n_sequences"]), row["n_sequences"])
        parts = {k: read_sequence(row.asDict(), k) for k in order}
        back += [int(x) for k in sorted(parts) for x in parts[k]["ids"][parts[k]["mask"]]]
        assert all(len(p["ids"]) == 32 for p in parts.values())
    assert back == [x for own in stream for x in own]


def test_many_batches_take_equal_bytes(frame):
    rows = frame("doc_id long, text string", [(1, "word " * (BATCH_SEQUENCES * 4 * 3 + 5))])
    (row,) = write_tokens(rows, PATH, 2, length=4).collect()
    ends = [k for k in range(row["n_sequences"]) if read_sequence(row.asDict(), k)["ends"].any()]
    assert row["n_sequences"] > 3 * BATCH_SEQUENCES and ends == [row["n_sequences"] - 1]


def test_null_and_repeated_ids_and_no_rows(frame):
    rows = frame("doc_id long, text string", [(None, "a"), (5, "b"), (5, "a a"), (5, "b"), (None, None)])
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in read_documents(write_tokens(rows, PATH, 2)).collect())
    assert got == [(0, None, 1), (1, None, 2), (3, 5, 3), (6, 5, 2), (8, 5, 2)]
    assert read_documents(write_tokens(frame("doc_id long, text string", []), PATH, 2)).count() == 0
