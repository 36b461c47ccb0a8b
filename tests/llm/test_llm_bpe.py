import random
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from overhaul.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
PIECES = ["a", "é", " ", "  ", "\n", "\t", "'s", "'", "'ll", "1", "<|endoftext|>", "<|endof", "!!", "the", " ", "\x1c", "漢",
          "\U0001f600", "%%%", "ing", "\x85", "　", "́"]


def library(text):
    return array("I", LIBRARY.encode(text, add_special_tokens=False).ids).tobytes()


def streamed(text, cuts):
    stream = bpe.TextStream(bpe.encoder(PATH))
    parts, at = [], 0
    for n in cuts:
        parts.append(stream.feed(text[at:at + n]))
        at += n
    return b"".join(parts) + stream.feed(text[at:]) + stream.finish()


def test_lookahead_is_sufficient_for_runs_cut_anywhere():
    pairs, rng = bpe.encoder(PATH).pairs, random.Random(3)
    assert 0 < pairs.lookahead < 1000
    for _ in range(40):
        data = "".join(rng.choice(["th", "e", "in", "ing", "er", " t", "a", "é", "==", "-"]) for _ in range(600)).encode()
        run, got, at = bpe.RunMerger(pairs), b"", 0
        while at < len(data):
            n = rng.choice([1, 5, 60, 300])
            got += run.feed(data[at:at + n])
            assert len(run.buffer) <= pairs.lookahead + run.block + 200
            at += n
        assert list(array("I", got + run.finish())) == pairs.merge(data)


def test_every_token_is_its_own_encoding():
    pairs = bpe.encoder(PATH).pairs
    assert all(pairs.merge(b) == [i] for i, b in pairs.token_bytes.items() if i not in pairs.specials.values())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(PIECES), st.sampled_from([1, 1, 1, 2, 40])), max_size=30), st.lists(st.integers(1, 90), max_size=12))
def test_equals_library_whole_streamed_and_in_lanes(parts, cuts):
    text = "".join(p * n for p, n in parts)
    expected, before = library(text), bpe.LONG_TAIL
    try:
        for bpe.LONG_TAIL in (20, before):
            assert streamed(text, cuts) == expected
    finally:
        bpe.LONG_TAIL = before
    enc = bpe.encoder(PATH)
    assert enc.encode(text) == expected
    assert enc.encode_batch([text, None, "x " + text]) == [expected, b"", library("x " + text)]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    enc = bpe.encoder(PATH)
    assert enc.encode(text) == library(text) == enc.encode_batch([text])[0]
    assert bpe.decode_ids(PATH, library(text)) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=40), st.integers(1, 5))
def test_decoder_in_parts(ids, n):
    decoder = bpe.Decoder(bpe.encoder(PATH).pairs.token_bytes)
    text = "".join(decoder.feed(ids[i:i + n]) for i in range(0, len(ids), n)) + decoder.finish()
    assert text == LIBRARY.decode(ids, skip_special_tokens=False)


def test_very_long_runs():
    for text in ("a" * 30000, "\n" * 9000 + "x", " " * 9000, "!%" * 6000 + "<|endoftext|>", "é" * 9000 + " b"):
        assert bpe.encoder(PATH).encode(text) == library(text) == streamed(text, [997] * 31)


def test_over_spark(docs, odd_docs, no_docs, texts):
    expected = sorted(((d, library(t or ""), t or "") for d, t in texts), key=str)
    for table in (docs, odd_docs):
        out = bpe.decode(bpe.encode(table, PATH), PATH)
        assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in out.collect()), key=str) == expected
    assert bpe.decode(bpe.encode(no_docs, PATH), PATH).count() == 0
