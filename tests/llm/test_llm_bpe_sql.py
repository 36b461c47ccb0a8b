import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from overhaul.llm import bpe_sql  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")
PIECES = ["a", "é", " ", "  ", "\n", "\t", "'s", "'", "'ll", "1", "<|endoftext|>", "!!", "the", "\x1c", "漢", "\U0001f600", "%%%",
          "ing", "\x85", "　", "́", "ſ", "²"]


def library(path):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_sql.read_ranks(path), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe_sql.Coder(PATH, P.PATTERN)


def encoded(coder, texts):
    ids, at = coder.encode(texts)
    assert coder.decode(ids, at) == [t.encode() for t in texts]
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_every_token_is_its_own_encoding(name):
    coder = bpe_sql.Coder(P.path(name), P.PATTERN)
    coder._prepare()
    ranks, coder.ranks = coder.ranks, {}
    tokens = list(ranks)
    for query in (bpe_sql.CONTRACT, bpe_sql.CONTRACT_LONG):
        assert [x.tolist() for x in coder._merge(query, tokens)] == [[ranks[t]] for t in tokens]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(PIECES), st.sampled_from([1, 1, 1, 2, 40])), max_size=30), max_size=4))
def test_equals_library(own, parts):
    texts = ["".join(p * n for p, n in t) for t in parts]
    assert encoded(own, texts) == [library(PATH).encode_ordinary(t) for t in texts]


def test_long_words_small_steps_and_both_queries(own, monkeypatch):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (3, 30, 64, 65, 66, 500, 3000)]
    texts += ["a" * 20_000, " " * 3000 + "x", "=-" * 2000, "ab" * 1001, "aab" * 700, "", "é" * 999]
    wanted = [library(PATH).encode_ordinary(t) for t in texts]
    for short, rows in ((64, 1 << 22), (0, 1 << 22), (64, 20_000)):
        monkeypatch.setattr(bpe_sql, "SHORT", short)
        monkeypatch.setattr(bpe_sql, "STEP_ROWS", rows)
        own.forget()
        assert encoded(own, texts) == wanted


def test_all_code_points(own):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(every[k:k + 4096]) for k in range(0, 0x3400, 4096)] + [" ".join(every[:0x3000])]
    assert encoded(own, texts) == [library(PATH).encode_ordinary(t) for t in texts]


def test_words_are_forgotten_but_results_stay(own, monkeypatch):
    monkeypatch.setattr(bpe_sql, "KNOWN", 5)
    texts = [f"some words number {k} wörds" for k in range(30)]
    for k in range(0, 30, 7):
        assert encoded(own, texts[k:k + 7]) == [library(PATH).encode_ordinary(t) for t in texts[k:k + 7]]


def test_decode_orders_what_the_join_returns(own, monkeypatch):
    """The join's rows are put in the order of their places, whichever order the database returns them in."""
    texts = ["", "some words", "", "漢字 wörds", " " * 40, ""]
    ids, at = own.encode(texts)
    monkeypatch.setattr(bpe_sql, "DECODE", bpe_sql.DECODE + " ORDER BY i.place DESC")
    assert own.decode(ids, at) == [t.encode() for t in texts]


def test_unknown_ids_are_an_error(own):
    import numpy as np

    with pytest.raises(ValueError):
        own.decode(np.array([5, 50256], np.int32), np.array([0, 2]))


def test_spark_round_trip(docs, odd_docs, no_docs, texts):
    out = bpe_sql.decode(bpe_sql.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    rows = sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in out.collect()), key=str)
    own = library(PATH)
    assert rows == sorted(((d, own.encode_ordinary(t or ""), (t or "").encode()) for d, t in texts), key=str)
    odd = bpe_sql.decode(bpe_sql.encode(odd_docs, PATH, P.PATTERN), PATH, P.PATTERN)
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in odd.collect()), key=str) == rows
    assert bpe_sql.decode(bpe_sql.encode(no_docs, PATH, P.PATTERN), PATH, P.PATTERN).collect() == []
    nothing = out.sparkSession.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, bytes(r.decoded)) for r in bpe_sql.decode(nothing, PATH, P.PATTERN).collect()) == [(1, b""), (2, b"")]
    assert out.select(F.max(F.size("ids"))).first()[0] > 1000
