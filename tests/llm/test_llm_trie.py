import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from overhaul.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def expected(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, tie, (role, text)))
    original = {c: [x[-1] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(original.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + own[h:])
    members = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []

    def visit(p):
        saved, leaves = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0), 0
        for q in children.get(p, []):
            s, n = visit(q)
            saved, leaves = saved + s, leaves + n
        leaves = leaves or 1
        ends = ",".join(str(c) for c in sorted(members[p]) if built[c] == p)
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children.get(p, [])), leaves,
                    saved, hashlib.sha256(ends.encode()).hexdigest()))
        return saved, leaves

    if members:
        visit(())
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, prefix_trie.trie(df).select(COLUMNS).collect()), key=str)


def conversations(seed, n, words, longest):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(words)) for c in rng.sample(range(2 * n), n) for t in range(rng.randrange(longest))]
    rows += [(c, t, "user", "hi") for c in range(1000, 1040) for t in range(3)]
    rows += [(100_000, t, "user", words[t % 2]) for t in range(40)]
    rng.shuffle(rows)
    return rows + [(None, 1, "user", "x"), (7, None, "user", None), (7, 2, "user", "x"), (7, 2, "bot", "y"), (7, 2, "bot", "y"),
                   (-205, 0, "a", "é" * 100_000), (-205, 1, None, ""), (-200, 0, "b", "c")]


@pytest.mark.parametrize("block, end_block", [(256, 4096), (3, 4)])
def test_nodes_equal_a_plain_trie(spark, monkeypatch, block, end_block):
    """Small blocks make three rounds of the scan and end lists of several texts."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = conversations(1, 120, ["a", "bb", "", None, "é漢"], 9)
    if end_block < 10:  # the size reaches the Python workers only with the function
        texts = list(prefix_trie._end_texts([_Rows(["s"] * 9 + ["t"], list(range(10)))]))
        assert sum((t["ids"][0].split(",") for t in texts), []) == [str(k) for k in range(10)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == expected(rows)


class _Rows:
    def __init__(self, *columns):
        self.columns = columns

    def column(self, k):
        return type("Column", (), {"to_pylist": lambda _: self.columns[k]})()


def test_end_texts_of_several_blocks_give_one_hash(monkeypatch):
    monkeypatch.setattr(prefix_trie, "END_BLOCK", 4)
    batches = [_Rows(["s"] * 5, [1, 2, 3, 4, 5]), _Rows(["s"] * 5 + ["t"] * 2, [6, 7, 8, 9, 10, -3, 12])]
    texts = [{k: v[0] for k, v in t.items()} for t in prefix_trie._end_texts(batches)]
    assert [t["first"] for t in texts] == [1, 5, 9, -3]
    merged = [_Rows([t["seq"] for t in texts[:2]], [t["ids"] for t in texts[:2]]),
              _Rows([t["seq"] for t in texts[2:]], [t["ids"] for t in texts[2:]])]
    out = [x for part in prefix_trie._end_hashes(merged) for x in zip(part["seq"], part["ends_sha256"])]
    assert out == [("s", hashlib.sha256(b"1,2,3,4,5,6,7,8,9,10").hexdigest()), ("t", hashlib.sha256(b"-3,12").hexdigest())]


def test_other_columns_empty_table_and_turnless_conversations(spark):
    rows = [(150, 0, "user", "a"), (151, 0, "user", "b"), (260, 0, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    odd = df.withColumns({c: F.lit(c) for c in ("seq", "place", "digest", "id", "before", "weight", "depth", "n_convs", "base", "h")})
    assert found(odd) == expected(rows)
    assert found(df.where("false")) == []


def test_equals_its_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as from read_parquet('{folder}/conversations.parquet')")
    rel = con.sql(prefix_trie.ORACLE).select(", ".join(COLUMNS))
    assert sorted(rel.fetchall(), key=str) == found(spark.read.parquet(f"{folder}/conversations.parquet"))
