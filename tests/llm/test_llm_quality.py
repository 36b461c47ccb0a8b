import re
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from overhaul.llm import quality
from overhaul.llm.queries import table


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_viterbi_equals_all_labellings():
    rng = np.random.default_rng(1)
    for n in range(1, 7):
        crf = quality.LineCrf(rng.normal(size=len(quality.FEATURES)), rng.normal(size=(2, 2)))
        rows = rng.normal(size=(n, len(quality.FEATURES)))

        def score(y):
            return sum(rows[i] @ crf.weights * y[i] for i in range(n)) + sum(crf.links[a, b] for a, b in zip(y, y[1:]))

        assert tuple(crf.viterbi(rows.tolist())) == max(product((0, 1), repeat=n), key=score)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c d", "#", "|", "\n", "\t", " ", "é", "a b c"]), max_size=60).map(" ".join))
def test_counts(text):
    features, sizes, words, dup = quality.document_lines(text)
    n, _, _, expected_dup, repeats, _ = brute(text)
    assert (len(words), sum(sizes), dup, quality.repeated_words(words)) == (n, n, expected_dup, repeats)
    assert all(len(f) == len(quality.FEATURES) and all(0 <= x < 1e6 for x in f) for f in features)


def test_over_spark(docs, odd_docs, no_docs, texts):
    short = [(d, t) for d, t in texts if t is None or len(t) < 4000]
    expected = sorted(((d, *brute(t)) for d, t in short), key=str)
    for frame in (docs, odd_docs):
        out = quality.score(frame.where("text IS NULL OR length(text) < 4000"), None)
        rows = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()]
        assert sorted(rows, key=str) == expected
        assert all(r.kept == (not r.base_failed) for r in out.collect())
    assert quality.score(no_docs, None).count() == 0


def test_without_both_qualities_there_is_no_model(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) is None


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels, texts = table(spark, sf, "labels"), table(spark, sf, "documents")
    crf = quality.train(texts, labels.where("doc_id % 2 = 0"))
    out = quality.score(texts, crf).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").collect()
    good = [r.kept for r in out if r.quality == 1]
    bad = [r.kept for r in out if r.quality == 0]
    assert sum(good) / len(good) > 0.98
    assert sum(bad) / max(1, len(bad)) < 0.2


@pytest.mark.parametrize("text", ["", None, "\n\n", "word " * 100000])
def test_extremes(text):
    features, sizes, words, _ = quality.document_lines(text or "")
    quality.LineCrf(np.zeros(len(quality.FEATURES)), np.zeros((2, 2))).keeps(features, sizes)
    assert quality.repeated_words(words) == len(words)
