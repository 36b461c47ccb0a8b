"""Words whose polynomials modulo 2**64 are equal for every odd base: Thue-Morse words and their complements."""

from array import array

import numpy as np
import pytest

from overhaul.llm import bpe, hashing, near_dedup, packing, search, substring_dedup

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def pair(size):
    word = "".join("ab"[bin(k).count("1") & 1] for k in range(size))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def twins(spark):
    """For three sizes, two texts of 61 words that differ in their first word only, and these words alone."""
    rest = " ".join(f"w{k}" for k in range(60))
    rows = []
    for n, size in enumerate((1024, 2048, 4096)):
        for k, word in enumerate(pair(size)):
            rows += [(10 * n + k, f"{word} {' '.join(f'{n}{w}' for w in rest.split())}"), (100 + 10 * n + k, word), (200 + 10 * n + k, f"{word} a b c d")]
    return spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA), rows


def test_hashes_differ():
    for size in (64, 128, 1024, 2048, 4096):
        words = [w.encode() for w in pair(size)]
        hashes, bounds = hashing.word_hashes(words)
        assert bounds.tolist() == [0, 1, 2] and hashes[0] != hashes[1]
    hashes, _ = hashing.word_hashes([b" ".join(w.encode() for w in pair(1024)) + b"  x \n", b"", b"x ab"])
    assert len(set(hashes.tolist())) == 4 and hashes[2] == hashes[3]
    short = hashing.few_hashes(hashes, np.array([0, 1, 0]), np.array([2, 2, 1]), 5)
    assert len(set(short.tolist())) == 3


def test_distinct_compares_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "letter_run_hashes", lambda data, begins, ends: np.zeros(len(begins), np.uint64))
    data = np.frombuffer(b"abcabdabc", np.uint8)
    distinct, which = bpe._distinct(data, np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert distinct.tolist() == [0, 1] and which.tolist() == [0, 1, 0]


def test_substring_dedup(twins):
    found = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.deduplicate(twins[0]).collect()}
    assert all(found[d] == (61, 60 if d % 10 else 0) for d in found if d < 100)


def test_near_dedup(twins):
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(twins[0]).collect()}
    # of 57 shingles 56 are common: linked; single words and texts of five words are not
    assert all(c == d - d % 10 if d < 100 else c == d for d, c in found.items())


def test_encoding_and_packing(twins):
    df, rows = twins
    library = tokenizers.Tokenizer.from_file(PATH)
    ids = {d: array("I", library.encode(t, add_special_tokens=False).ids).tobytes() for d, t in rows}
    assert {r.doc_id: bytes(r.ids) for r in bpe.encode(df, PATH).collect()} == ids
    pieces = {}
    for r in sorted(packing.pack(df, PATH).collect(), key=lambda r: (r.doc_id, r.start)):
        pieces[r.doc_id] = pieces.get(r.doc_id, b"") + bytes(r.ids)
    assert pieces == {d: x + bytes(4) for d, x in ids.items()}


def test_search(spark, twins):
    asked = spark.createDataFrame([(1, pair(1024)[1]), (2, pair(4096)[0])], "query_id long, text string")
    found = {(r.query_id, r.doc_id) for r in search.search(twins[0], asked).collect()}
    assert found == {(1, 1), (1, 101), (1, 201), (2, 20), (2, 120), (2, 220)}
