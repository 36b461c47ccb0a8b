import json
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from overhaul.llm import chat, licenses, packing, queries, search
from overhaul.llm.hashing import TERM_GAP, word_hashes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for t in "documents pages benchmark labels conversations".split():
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out = queries.QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    rows = duck.sql(queries.ORACLES[name])
    assert sorted(rows.columns) == columns
    expected = sorted(map(str, rows.project(", ".join(f'"{c}"' for c in columns)).fetchall()))
    assert sorted(str(tuple(r)) for r in out.select(*columns).collect()) == expected


def test_every_operator_has_one_query():
    numbers = Counter(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == Counter(range(1, 14))


# --- licences


def test_whole_licences_in_all_forms_and_among_other_text(spark):
    texts = dict(licenses.bodies())
    rows = [(name, text) for name, text in licenses.whole_texts()]
    docs = [(k, text, name) for k, (name, text) in enumerate(rows)]
    docs += [(1000 + k, f"Readme\n\nCopyright 2020 x\n\n{text}\n\nContact us.", name) for k, (name, text) in enumerate(texts.items())]
    docs += [(2000, texts["MIT"].replace("as is", "").rpartition("\n\n")[0], None), (2001, "x\n\n" + "\n\n".join(
        [texts["BSD-3-Clause"], texts["BSD-2-Clause"], texts["MIT"]]), None)]
    out = {}
    for r in licenses.scan(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")).collect():
        out.setdefault(r.doc_id, {})[r.licence] = (r.whole_text, r.n_paragraphs > 0)
    for k, _, name in docs:
        if k < 2000:
            assert out[k] == {name: (k < 1000, k >= 1000)}, (k, name)
    assert 2000 not in out and out[2001] == {n: (False, True) for n in ("BSD-3-Clause", "BSD-2-Clause", "MIT")}



def test_licences(spark, docs, odd_docs, no_docs):
    mit = licenses.MIT.replace("the authors", "2020 Somebody & Co.").replace("sublicense", "sub-license").upper()
    rows = [(1, mit), (2, "Intro\n\nreleased under the  M.I.T... licence"), (3, "x\nReleased under the MIT licence!\n\ny"),
            (4, licenses.ISC + "\n\nAll rights reserved."), (5, None), (6, ""), (7, "Copyright 2020 x"), (None, "Released under the MIT License."),
            (3, "Released under the MIT License"), (8, "Licensed under the Apache Licence, v 2.0"), (9, "MIT License")]
    out = {(r.doc_id, r.licence): (r.whole_text, r.n_paragraphs, r.n_lines)
           for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(1, "MIT"): (True, 0, 0), (3, "MIT"): (True, 1, 2), (4, "ISC"): (True, 0, 0), (None, "MIT"): (True, 1, 1),
                   (8, "Apache-2.0"): (True, 1, 1)}
    assert licenses.scan(no_docs).count() == 0
    assert licenses.scan(odd_docs).collect() == licenses.scan(docs).collect() == []


def test_every_known_text_holds_a_hint(spark):
    known = spark.createDataFrame(licenses.NOTICES + licenses.TEXTS, "licence string, text string")
    assert known.where(~licenses._hinted(known["text"], licenses.HINTS)).count() == 0


# --- tool calls


def test_canonical_json_round_trip():
    value = {"b": [1.0, 2.5, True, None, "é\u2028\""], "a": {"z": 1e20, "ü": -0.0}, "": []}
    text = chat.canonical_json(value)
    assert json.loads(text) == value and text == chat.canonical_json(json.loads(text))
    assert text.startswith('{"":[],"a":{') and " " not in text


def test_schema():
    schema = {"type": "object", "required": ["n"], "additionalProperties": False,
              "properties": {"n": {"type": "integer", "minimum": 1, "maximum": 3}, "s": {"type": ["string", "null"], "maxLength": 2},
                             "l": {"type": "array", "items": {"enum": ["x", "y"]}}}}
    assert chat.violations({"n": 2, "s": None, "l": ["x"]}, schema) == []
    assert chat.violations({"n": {"$result": "a"}}, schema) == []
    assert chat.violations({"n": 9, "s": "abc", "l": ["z"], "q": 1}, schema) == [
        "$.l[0]: not in enum", "$.n: too large", "$.q: unknown", "$.s: too long"]
    assert chat.violations({}, schema) == ["$.n: missing"] and chat.violations([], schema) == ["$: not object"]
    assert chat.violations({"n": True}, schema) == ["$.n: not integer"]


def test_linking(spark):
    need = lambda *ids: json.dumps({"x": [{"$result": i} for i in ids]})
    calls = [(1, 0, "a", "t", need()), (1, 2, "b", "t", need("a")), (1, 3, "c", "t", need("a", "b", "zzz")), (1, 4, "d", "t", need("d")),
             (1, 5, "e", "t", "{"), (1, 6, "f", "u", "{}"), (1, 7, "g", "t", need("c", "d")), (2, 0, "a", "t", need()), (2, 1, "a", "t", need("b")),
             (None, 0, "a", "t", "{}"), (1, 0, None, "t", "{}"), (3, 0, "a", "t", None)]
    results = [(1, 1, "a", "ra"), (1, 9, "a", "late"), (1, 3, "b", None), (1, 4, "c", "rc"), (7, 0, "a", "orphan"), (None, 0, "a", "x"),
               (1, 8, "d", "rd"), (1, 8, "e", "re")]
    c = spark.createDataFrame([(*r, "k") for r in calls], "conv_id long, turn long, call_id string, name string, arguments string, depth string")
    r = spark.createDataFrame([(*x, 1) for x in results], "conv_id long, turn long, call_id string, content string, n int")
    schemas = {"t": {"type": "object", "properties": {"x": {"type": "array"}}}}
    out = {(x.conv_id, x.call_id): x for x in chat.link(c, r, schemas).collect()}
    assert {k: (x.depth, x.status, x.n_results) for k, x in out.items()} == {
        (1, "a"): (0, "linked", 2), (1, "b"): (1, "linked", 1), (1, "c"): (2, "linked", 1), (1, "d"): (None, "cyclic", 1),
        (1, "e"): (0, "invalid_arguments", 1), (1, "f"): (0, "invalid_arguments", 0), (1, "g"): (None, "cyclic", 0),
        (2, "a"): (0, "missing_result", 0), (3, "a"): (0, "invalid_arguments", 0)}
    assert json.loads(out[1, "a"].record)["result"] == {"content": "ra", "turn": 1}
    assert chat.link(c.limit(0), r.limit(0), schemas).count() == 0


def test_tool_calls_of_turns(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = {(r.conv_id, r.turn): r for r in turns.collect()}
    out = queries.op6_tool_calls(spark, SF).collect()
    assert len(out) == sum(r.role == "user" for r in rows.values())
    for r in out:
        said, answer = rows[r.conv_id, r.turn], rows.get((r.conv_id, r.turn + 1))
        record = json.loads(r.record)
        assert record["arguments"]["query"] == said.text
        good = answer is not None and answer.role == "assistant"
        assert (record["result"] is not None) == good and (r.n_results == 1) == good
        assert ("limit" in r.errors) == (not 20 <= len(said.text) <= 400)


# --- search


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", low)


def brute_search(rows, queries, k):
    docs = [(d, Counter(terms(t))) for d, t in rows if d is not None]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(t for _, c in docs for t in c)
    out = {}
    for q, text in queries:
        scores = []
        for d, c in docs:
            size = sum(c.values())
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size / mean))
                    for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-round(s, 5), d))
        out[q] = sorted(scores)[:k]
    return out


def test_terms():
    data = "Ab,c-É 12_x don't\u00a0y".encode().lower()
    words, _ = word_hashes([data], gaps=TERM_GAP)
    assert len(words) == len(terms(data.decode()))


@pytest.mark.parametrize("block, shard", [(4, 13), (256, 1 << 15)])
def test_search(spark, texts, docs, odd_docs, no_docs, monkeypatch, block, shard):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    monkeypatch.setattr(search, "QUERY_TERMS", 500)
    queries = [(d, t) for d, t in dict(texts).items() if d is not None and d % 20 == 0 and t] + [(9999, "nothing matches qqqq zzzz9")]
    expected = brute_search(texts, queries, 10)
    asked = spark.createDataFrame(queries + [(None, "a"), (8888, None)], "query_id long, text string")
    for frame in (docs, odd_docs):
        got = {}
        for r in search.search(frame, asked).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((-r.score, r.doc_id))
        assert set(got) == {q for q, rows in expected.items() if rows}
        for q, rows in got.items():
            assert [d for _, d in rows] == [d for _, d in expected[q]]
            assert np.allclose([s for s, _ in rows], [s for s, _ in expected[q]], atol=1e-4)
    assert search.search(no_docs, asked).count() == 0
    assert search.search(docs, asked.limit(0)).count() == 0


def test_pruned_top_equals_full_scores():
    rng = np.random.default_rng(6)
    search_block, search.BLOCK = search.BLOCK, 8
    try:
        terms = [np.unique(rng.integers(0, 60, rng.integers(1, 25)).astype(np.uint64)) for _ in range(300)]
        row = search.build_shard(list(range(300)), terms, [rng.integers(1, 5, len(t)) for t in terms])
        shard = search.Shard({k: v.tobytes() for k, v in row.items()}, 20.0)
        for _ in range(100):
            at = shard.find(np.unique(rng.integers(0, 70, rng.integers(1, 12)).astype(np.uint64)))
            at = at[at >= 0]
            weights = rng.random(len(at)) * 5
            full = np.round(shard.scores(at, weights), search.DIGITS)
            best = np.lexsort((shard.docs, -full))[:7]
            best = best[full[best] > 0]
            docs, scores = shard.top(at, weights, 7, 0.0)
            assert docs.tolist() == shard.docs[best].tolist() and scores.tolist() == full[best].tolist()
            for k, s in enumerate(full):
                assert s <= shard.bounds(at, weights)[k // 8] + 1e-5
    finally:
        search.BLOCK = search_block


@pytest.mark.parametrize("dense, cells, meetings", [(512, 1 << 23, 1 << 21), (0, 1 << 23, 7), (3, 60, 1 << 21), (1 << 30, 1 << 23, 5)])
def test_queries_scored_together_equal_full_scores(monkeypatch, dense, cells, meetings):
    for name, value in (("BLOCK", 8), ("DENSE", dense), ("CELLS", cells), ("MEETINGS", meetings), ("COLUMNS", 7)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(8)
    asked = [np.unique(rng.integers(0, 70, n).astype(np.uint64)) for n in (1, 5, 40, 0, 3, 60, 12)]
    weights = [rng.random(len(t)) * 5 for t in asked]
    owner = np.repeat(np.arange(len(asked)), [len(t) for t in asked])
    best, everything = search.Best(len(asked), 7), [[] for _ in asked]
    for first_id, n in ((0, 300), (900, 90), (5000, 1)):
        terms = [np.unique(rng.integers(0, 60, rng.integers(0, 25)).astype(np.uint64)) for _ in range(n)]
        terms[n // 2:n // 2 + 20] = [terms[0]] * len(terms[n // 2:n // 2 + 20])  # copies: ties by doc_id
        row = search.build_shard(list(range(first_id, first_id + n)), terms, [rng.integers(1, 2, len(t)) for t in terms])
        shard = search.Shard({k: v.tobytes() for k, v in row.items()}, 20.0)
        found = shard.find(np.concatenate(asked))
        search.score_shard(shard, best, 0, owner[found >= 0], found[found >= 0], np.concatenate(weights)[found >= 0], len(asked))
        for q, (t, w) in enumerate(zip(asked, weights)):
            at = shard.find(t)
            full = np.round(shard.scores(at[at >= 0], w[at >= 0]), search.DIGITS)
            everything[q] += [(-s, d) for s, d in zip(full.tolist(), shard.docs.tolist()) if s > 0]
    for q, rows in enumerate(everything):
        rows = sorted(rows)[:7]
        assert best.docs[q, :len(rows)].tolist() == [d for _, d in rows]
        assert np.allclose(best.scores[q, :len(rows)], [-s for s, _ in rows], atol=2e-6) and not best.scores[q, len(rows):].any()


@pytest.mark.parametrize("wide, dense", [(1, 512), (1 << 30, 512), (20, 0), (20, 1 << 30), (20, 10)])
def test_parts_scored_without_bounds_give_the_best(monkeypatch, wide, dense):
    """The whole of each part, copies at the k-th score among it; few pairs are scored twice."""
    for name, value in (("BLOCK", 8), ("PART", 150), ("WIDE", wide), ("MEETINGS", 50), ("DENSE", dense), ("EXACT", 64), ("SHARE", -1.0), ("SAMPLE", 3)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(11)
    terms = [np.unique(rng.integers(a, a + 90, rng.integers(0, 40)).astype(np.uint64)) for a in (rng.integers(0, 3, 700) * 60).tolist()]
    terms[300:330] = [terms[5]] * 30
    row = search.build_shard(list(range(700)), terms, [rng.integers(1, 5, len(t)) for t in terms])
    shard = search.Shard({k: v.tobytes() for k, v in row.items()}, 20.0)
    assert sorted(shard.docs.tolist()) == list(range(700)) and [len(p.docs) for p in shard.parts()] == [140] * 5
    asked = [*terms[:40], np.zeros(0, np.uint64), np.array([3, 1000], np.uint64)]
    weights = [rng.random(len(t)) * 5 for t in asked]
    owner = np.repeat(np.arange(len(asked)), [len(t) for t in asked])
    found, flat = shard.find(np.concatenate(asked)), np.concatenate(weights)
    here = found >= 0
    columns = search.Columns(shard.parts()[0], owner[here], found[here], flat[here], len(asked))
    again = columns.candidates(np.zeros(len(asked)), 7)[0]
    assert 0 < len(again) < 140 * len(asked) / 2
    best = search.Best(len(asked), 7)
    search.score_shard(shard, best, 0, owner[here], found[here], flat[here], len(asked))
    for q, (t, w) in enumerate(zip(asked, weights)):
        at = shard.find(t)
        full = np.round(shard.scores(at[at >= 0], w[at >= 0]), search.DIGITS)
        rows = [(s, d) for s, d in sorted(zip((-full).tolist(), shard.docs.tolist())) if s < 0][:7]
        assert best.docs[q, :len(rows)].tolist() == [d for _, d in rows]
        assert np.allclose(best.scores[q, :len(rows)], [-s for s, _ in rows], atol=2e-6) and not best.scores[q, len(rows):].any()


@pytest.mark.parametrize("share", [-1.0, 1.0])
def test_floors_leave_out_what_does_not_reach_them(monkeypatch, share):
    """Short documents and unlike queries are not scored; what reaches a floor is found, at the floor too."""
    for name, value in (("BLOCK", 8), ("SHARE", share), ("SAMPLE", 3), ("ROWS", 4), ("MEETINGS", 50)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(13)
    terms = [np.unique(rng.integers(0, 90, n).astype(np.uint64)) for n in [40] * 200 + [3] * 300]
    row = search.build_shard(list(range(500)), terms, [rng.integers(1, 5, len(t)) for t in terms])
    shard = search.Shard({k: v.tobytes() for k, v in row.items()}, 20.0)
    asked = [*terms[:20], *(np.append(t[:1], 1000 + t) for t in terms[20:40])]  # half share one term with the documents
    weight = rng.random(2000) * 5
    owner = np.repeat(np.arange(len(asked)), [len(t) for t in asked])
    found = shard.find(np.concatenate(asked))
    here = found >= 0
    flat = weight[np.concatenate(asked).astype(np.int64)]
    full = [np.round(shard.scores(a[a >= 0], weight[t[a >= 0].astype(np.int64)]), search.DIGITS) for t in asked for a in [shard.find(t)]]
    floor = np.array([np.sort(s)[-4] for s in full[:20]] + [1e3] * 20)
    size = []
    candidates = search.Columns.candidates
    monkeypatch.setattr(search.Columns, "candidates", lambda c, f, k: size.append((c.n, c._reach(f.min()))) or candidates(c, f, k))
    best = search.Best(len(asked), 7, floor)
    search.score_shard(shard, best, 0, owner[here], found[here], flat[here], len(asked))
    assert all(n == (40 if share < 0 else 20) and docs <= 200 for n, docs in size)
    for q, s in enumerate(full):
        rows = [(-v, d) for v, d in sorted(zip((-s).tolist(), shard.docs.tolist())) if -v >= floor[q]][:7]
        assert best.docs[q, :len(rows)].tolist() == [d for _, d in rows] and not best.scores[q, len(rows):].any()
        assert best.floor[q] >= floor[q]


def test_rows_of_all_tasks_grow_with_the_queries_only(spark, monkeypatch):
    made = []

    def counted(df, label):
        out = stage(df, label)
        made.extend([out.count()] if label == "found" else [])
        return out

    stage = search.stage
    monkeypatch.setattr(search, "stage", counted)
    monkeypatch.setattr(search, "FIRST", 4)
    rng = np.random.default_rng(14)
    rows = [(i, " ".join(f"w{int(w)}" for w in rng.zipf(1.3, 30) % 500)) for i in range(600)]
    queries = rows[::60]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 40), "doc_id long, text string")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]
    try:
        for name in names:  # a task for each shard
            spark.conf.set(name, str(1 << 16))
        found = search.search(docs, spark.createDataFrame(queries, "query_id long, text string")).orderBy("query_id", "rank").collect()
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    assert sum(made) < 40 * 10 * len(queries) / 2
    expected = brute_search(rows, queries, 10)
    for q, _ in queries:
        assert [r.doc_id for r in found if r.query_id == q] == [d for _, d in expected[q]]


def test_like_texts_lie_together():
    rng = np.random.default_rng(12)
    terms = [np.unique(rng.integers(a, a + 200, 60)).astype(np.uint64) for a in [0, 1000] * 400]  # two vocabularies take turns
    order = search.alike(terms)
    assert sorted(order.tolist()) == list(range(800)) and (np.diff(order % 2) != 0).sum() == 1
    assert search.alike([]).tolist() == []
    for same in (terms[0], np.zeros(0, np.uint64)):
        assert sorted(search.alike([same] * 500).tolist()) == list(range(500))


# --- pipeline


def test_pipeline_stages(spark, docs, texts):
    """Every stage's rows against the operators' definitions, on its own input."""
    from test_llm_dedup import cut_by_definition, groups_by_definition
    from test_llm_quality import brute

    rows = {(d, t) for d, t in texts}
    out = docs
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "substring_dedup", "packing"]
    kept = stages["quality_rules"](spark, out, SF).cache()
    assert kept.columns == docs.columns
    passed = {(r.doc_id, r.text) for r in kept.collect()}
    assert passed <= {(d, t) for d, t in rows if t and not brute(t)[5]}
    single = stages["near_dedup"](spark, kept, SF).cache()
    given = [(r.doc_id, r.text) for r in kept.collect()]
    expected = [r[0] for r in groups_by_definition(given) if r[3]]
    assert sorted(map(str, (r.doc_id for r in single.collect()))) == sorted(map(str, expected))
    cut = stages["substring_dedup"](spark, single, SF).cache()
    assert cut.columns == docs.columns
    given = [(r.doc_id, r.text) for r in single.collect()]
    changed = {(d, text) for d, _, gone, text in cut_by_definition(given) if gone}
    assert changed and {(r.doc_id, r.text) for r in cut.collect()} == changed | {
        (d, t) for d, t in given if d not in {c for c, _ in changed}}
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    pieces = stages["packing"](spark, cut, SF)
    assert sum(r.length for r in pieces.collect()) == sum(
        r.doc_tokens for r in packing.pack(cut, queries.vocabulary()).collect() if r.start == 0)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None
