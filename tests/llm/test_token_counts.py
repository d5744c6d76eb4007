from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from depotflow.llm.token_counts import RUN, SPACE, Transducer, Vocabulary, chunk_map, compose, count_tokens, run_count, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, n_tokens string, group string"


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts_of_all_kinds(vocabulary, n):
    rng = random.Random(5)
    names, chars = vocabulary.names, sorted(vocabulary.classes)
    kinds = [
        lambda: "".join(rng.choice(names) for _ in range(rng.randint(1, 30))),
        lambda: "".join(rng.choice("etaoin shrdlu") for _ in range(rng.randint(1, 200))),
        lambda: "".join(rng.choice("ab ") for _ in range(rng.randint(1, 60))),
        lambda: " " * rng.randint(1, 200) + rng.choice(["", "x", "\t", "the"]),
        lambda: "".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x4E00, 0x9FFF), rng.randint(0x1F300, 0x1F6FF), 32])) for _ in range(40)),
        lambda: "".join(rng.choice(chars) for _ in range(rng.randint(1, 80))),
        lambda: "".join(rng.choice(names[:400]).replace(SPACE, "") for _ in range(rng.randint(1, 300))),
        lambda: " ".join(rng.choice(names[:3000]) for _ in range(rng.randint(1, 50))),
    ]
    return [kinds[k % len(kinds)]() for k in range(n)]


def test_counts_equal_the_library(vocabulary, library):
    texts = texts_of_all_kinds(vocabulary, 2400)
    want = [len(x) for x in library.encode(texts)]
    raw = [t.encode() for t in texts]
    assert count_tokens(Transducer(vocabulary), raw).tolist() == want
    assert count_tokens(Transducer(vocabulary), raw, chunk=5, run=10**9).tolist() == want


def test_maps_of_chunks_compose_to_the_same_counts(vocabulary, library):
    """With chunks of a few characters, nearly every stretch is composed from maps."""
    texts = texts_of_all_kinds(vocabulary, 400)
    assert count_tokens(Transducer(vocabulary), [t.encode() for t in texts], chunk=4, run=33).tolist() == [len(x) for x in library.encode(texts)]


def test_composition_is_associative_and_has_one_way_through(vocabulary):
    codes = vocabulary.classify(SPACE + "antidisestablishmentarianism" * 12).tolist()
    edges = [0, 40, 90, 200, len(codes)]
    a, b, c, d = (chunk_map(vocabulary, codes, x, z) for x, z in zip(edges, edges[1:]))
    left, right = compose(compose(compose(a, b), c), d), compose(compose(a, b), compose(c, d))
    assert left == right and [len(w) for w in left.values()] == [1]
    assert [*left[-1, 0].values()] == [run_count(vocabulary, np.array(codes), 64)]


def test_a_long_text_without_a_place_to_begin(vocabulary, library):
    text = "abcdefgh" * 3 * RUN
    other = "".join(random.Random(3).choice("abcdefghij") for _ in range(5 * RUN))
    assert count_tokens(Transducer(vocabulary), [text.encode(), b"", other.encode()]).tolist() == [len(library.encode(text)), 0, len(library.encode(other))]


def test_states_may_be_forgotten_at_any_time(vocabulary, library):
    transducer = Transducer(vocabulary, max_states=50)
    texts = texts_of_all_kinds(vocabulary, 60)
    got = [int(count_tokens(transducer, [t.encode()])[0]) for t in texts]
    assert got == [len(x) for x in library.encode(texts)]


def test_every_row_is_counted(frame, library):
    rows = [(1, "Hello  world", "own", "a"), (2, None, None, None), (None, "a", "", ""), (1, "Hello  world", "own", "a"), (3, "", "x", "x"), (4, "<s>é</s>" * 2000, "", "")]
    got = sorted((tuple(r) for r in token_counts(frame(DOCS, rows), PATH).collect()), key=repr)
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t, *_ in rows]
    assert got == sorted(want, key=repr)
    assert token_counts(frame(DOCS, []), PATH).count() == 0


def test_another_kind_of_model_is_refused(tmp_path):
    with pytest.raises(Exception):
        Vocabulary(str(tmp_path / "none.model"))


def test_query_over_a_whole_table(spark, library):
    from depotflow.llm.queries import op11_token_counts

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    got = op11_token_counts(spark, "/root/testdata/sf0.01").toPandas().sort_values("doc_id")
    docs = docs.sort_values("doc_id")
    assert got["n_tokens"].tolist() == [len(x) for x in library.encode(docs["text"].tolist())]
    assert got["n_bytes"].tolist() == [len(t.encode()) for t in docs["text"]]
