import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from overhaul.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout):
    """Root and, for each node, the runs beside it, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            a = p // fanout * fanout
            run = nodes[a:a + fanout]
            paths[k].append((run[:p - a], run[p - a + 1:]))
            at[k] = p // fanout
        nodes = [digest(*nodes[a:a + fanout]) for a in range(0, len(nodes), fanout)]
    return nodes[0], paths


def expected(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, digest(*map(enc, r)), r))
    done = []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        leaves = sorted(groups[source], key=lambda x: x[:3])
        done.append((leaves, *tree([x[2] for x in leaves], fanout)))
    root, tops = tree([sub for _, sub, _ in done], fanout)
    out = []
    for (leaves, sub, paths), top in zip(done, tops):
        for (_, _, leaf, r), path in zip(leaves, paths):
            path, node = path + top, leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = digest(*map(enc, (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))))
            for before, after in path:
                node = digest(*before, node, *after)
            out.append((r[0], leaf, sub, root, digest(*(x for b, a in path for x in b + a)), node, node == root))
    return sorted(out, key=str)


def found(df):
    proven = merkle.prove(merkle.with_leaves(df), "source", ["doc_id"])
    return sorted(map(tuple, proven.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(), merkle.fold("held").alias("folded"),
        F.expr("aggregate(path, held, (n, x) -> sha2(concat(x.before, n, x.after), 256)) = root")).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    rows = [(k, None if k % 17 == 0 else f"s{rng.choice([0] * 20 + list(range(6)))}", "en", k,
             None if k % 11 == 0 else f"Text É {k % 7}") for k in range(400)]
    return rows + [(None, "s1", None, None, None), (3, "lone", "x", None, ""), (5, "s2", "e", 1, "A"), (5, "s2", "e", 1, "A"),
                   (6, "é", "e", 9, "B" * 300_000), (-1, "s0", "", -1, "x")]


@pytest.mark.parametrize("fanout, height", [(16, 2), (3, 1), (4, 2)])
def test_proofs_equal_a_plain_tree(spark, rows, monkeypatch, fanout, height):
    """Small fan-outs make several rounds inside groups and over them, with incomplete runs."""
    monkeypatch.setattr(merkle, "FANOUT", fanout)
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", fanout ** height)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == expected(rows, fanout)


def test_one_row_no_rows_and_other_columns(spark, rows):
    one = spark.createDataFrame(rows[1:2], SCHEMA)
    assert found(one) == expected(rows[1:2], 16)
    assert found(one.where("false")) == []
    odd = spark.createDataFrame(rows[:40], SCHEMA).withColumns({c: F.lit(c) for c in ("leaf", "node", "root", "path", "rank", "part", "at", "held")})
    assert found(odd) == expected(rows[:40], 16)


def test_a_changed_text_is_not_verified(spark, rows):
    verdicts = {(r[0], r[-1]) for r in found(spark.createDataFrame(rows[:100], SCHEMA))}
    assert {d for d, ok in verdicts if not ok} == {r[0] for r in rows[:100] if zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4]}
