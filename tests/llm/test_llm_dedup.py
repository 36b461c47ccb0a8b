import hashlib
import math

import numpy as np
import pytest

from overhaul.llm import near_dedup, substring_dedup
from overhaul.llm.components import components
from overhaul.llm.queries import op1_substring_dedup


def cut_by_definition(rows):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    starts = {}
    for d, w in words:
        for i in range(len(w) - 49):
            if d is not None:
                key = tuple(w[i:i + 50])
                starts[key] = min(d, starts.get(key, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - 49):
            if d is not None and starts[tuple(w[i:i + 50])] < d:
                gone.update(range(i, i + 50))
        out.append((d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups_by_definition(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    near = {d: d for d, _ in sets if d is not None}
    changed = True
    while changed:
        changed = False
        for d, a in sets:
            for e, b in sets:
                if d is not None and e is not None and a and b and 100 * len(a & b) >= 85 * len(a | b) and near[e] < near[d]:
                    near[d], changed = near[e], True
    return sorted(((d, len(s), near.get(d), d is None or near[d] == d) for d, s in sets), key=str)


def test_cover_is_a_perfect_difference_set():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))
    assert substring_dedup.PERIOD - 1 + substring_dedup.ANCHOR <= substring_dedup.WINDOW


def test_substrings(docs, odd_docs, no_docs, texts, sorted_rows):
    expected = cut_by_definition(texts)
    assert sum(r[2] for r in expected) > 500
    assert sorted_rows(substring_dedup.deduplicate(docs)) == expected
    wide = substring_dedup.deduplicate(odd_docs, rows=True)
    assert sorted_rows(wide.drop("row")) == expected
    assert wide.select("row.*").columns == odd_docs.columns
    assert substring_dedup.deduplicate(no_docs).count() == 0


def test_rows_of_one_id_with_different_texts(spark, sorted_rows):
    a, b = " ".join(map(str, range(60))), " ".join(map(str, range(10, 80)))
    rows = [(1, a), (1, b), (2, b), (2, None), (3, a + " " + b)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted_rows(substring_dedup.deduplicate(table)) == cut_by_definition(rows)


def test_near_duplicates(docs, odd_docs, no_docs, texts, sorted_rows):
    expected = groups_by_definition(texts)
    assert sum(not r[3] for r in expected) > 15
    assert sorted_rows(near_dedup.near_duplicates(docs)) == expected
    assert sorted_rows(near_dedup.near_duplicates(odd_docs)) == expected
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_links_that_miss_the_leader(spark, sorted_rows, monkeypatch):
    """A loose group: many classes are linked to each other but not to their list's leader."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = np.random.default_rng(4)
    base, rows = [f"w{k}" for k in range(120)], []
    for k in range(60):
        copy = list(base)
        for i in rng.choice(120, rng.integers(0, 5), replace=False):
            copy[i] = f"x{rng.integers(0, 4)}"
        rows.append((k, " ".join(copy)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted_rows(near_dedup.near_duplicates(table)) == groups_by_definition(rows)


def test_joining_links_are_a_forest_of_true_links():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(40)]
    node, side = np.arange(40), rng.integers(0, 2, 40)
    found = near_dedup.joining_links(side, node, node.copy(), sets)
    true = {(i, j) for i in range(40) for j in range(40) if i != j and side[i] == 0 and near_dedup.linked(sets[i], sets[j])}
    assert set(found) <= true

    def closed(edges):
        near = list(range(40))
        for _ in range(40):
            for a, b in edges:
                near[a] = near[b] = min(near[a], near[b])
        return near

    assert closed(found) == closed(true)


def test_sketches_never_drop_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        a = np.unique(pool[:n])
        b = np.unique(np.concatenate([a[: max(1, math.ceil(len(a) * 0.93))], pool[n:n + int(n * 0.05)]]))
        if near_dedup.linked(a, b):
            assert near_dedup.sketches_allow(a[:near_dedup.SKETCH], b[:near_dedup.SKETCH])


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 300)]
    out = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert out == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 160)} | {200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_on_test_data(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    expected = sorted((d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in cut_by_definition(rows))
    assert sorted(map(tuple, op1_substring_dedup(spark, sf).collect())) == expected
