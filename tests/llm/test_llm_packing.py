import random
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from overhaul.llm import packing  # noqa: E402
from overhaul.llm.bpe import encoder  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


def best_by_definition(count, length, size):
    """The level whose choice makes the sum of squared counts of open windows smallest; ties take the fullest."""
    def after(level):
        new = Counter(count)
        if level:
            new[level] -= 1
        if level + length < size:
            new[level + length] += 1
        return sum(n * n for n in new.values())

    levels = [h for h in range(size - length, 0, -1) if count.get(h)] + [0]
    return min(levels, key=after)


def test_levels_follow_the_sum_of_squares():
    rng, packer = random.Random(5), packing.Packer(64, 0)
    for _ in range(600):
        n = rng.randrange(1, 64)
        count = {h: int(c) for h, c in enumerate(packer.count) if c}
        assert packer.best_level(n) == best_by_definition(count, n, 64)
        packer.add(0, b"\1\0\0\0" * n)
        assert packer.opened == sum(map(len, packer.open)) == packer.count.sum()


def check(rows, expected, size):
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
        windows[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_length"]))
        assert len(r["ids"]) == 4 * r["length"] > 0
    for w in windows.values():
        end = 0
        for offset, length, total in sorted(w):
            assert offset == end
            end += length
        assert end == total <= size and (end == size or end & (end - 1) == 0)
    got = Counter()
    for (doc, total), parts in pieces.items():
        joined = b"".join(ids for _, ids in sorted(parts))
        n = len(joined) // (4 * total)  # repeated rows
        assert len(joined) == 4 * total * n
        got[doc, total] += n
    assert got == expected


@pytest.mark.parametrize("max_open", [3, 4096])
def test_all_ids_once_and_no_padding(max_open):
    rng, packer, docs = random.Random(2), packing.Packer(128, 7 << 40, max_open), {}
    for k in range(400):
        docs[k] = np.arange(rng.choice([1, 5, 70, 80, 128, 300]), dtype="<u4").tobytes()
        packer.add(k, docs[k])
        assert packer.opened <= max_open + 1
    packer.finish()
    out = packer.taken()
    rows = [dict(zip(out, values)) for values in zip(*out.values())]
    check(rows, Counter((k, len(d) // 4) for k, d in docs.items()), 128)
    for k, d in docs.items():
        assert b"".join(r["ids"] for r in sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["start"])) == d


def test_over_spark(docs, odd_docs, no_docs, texts):
    enc = encoder(PATH)
    expected = Counter((d, len(enc.encode(t)) // 4 + 1) for d, t in texts)
    for table in (docs, odd_docs):
        check([r.asDict() for r in packing.pack(table, PATH).collect()], expected, 1024)
    assert packing.pack(no_docs, PATH).count() == 0
