"""Byte-level BPE by recursive queries: a DuckDB in each task encodes and decodes the rows of its partition.

Each task streams its partition in slices of about ``SLICE`` characters. A
slice's texts are cut into words by the vocabulary's pattern; words that the
task has not met yet become rows (word, place, token), one a byte, and a recursive query
joins neighbouring rows with the merge table and contracts the leftmost pair of
least rank of every word, step by step, until no word has a pair left. In words
of more than ``SHORT`` bytes a step also takes the later occurrences of that pair
that do not overlap. That gives what one at a time gives: in a vocabulary whose
tokens all encode to themselves (tested for the given files) a new pair never
ranks before the one that made it. A recursive query keeps all its steps, so it
stops after as many as ``STEP_ROWS`` rows allow and the next one goes on from
there; memory is a slice, the found words (about ``KNOWN``, then the task starts
anew) and some hundred bytes for each byte of the longest word.

Decoding joins the id rows with the vocabulary's bytes; put in the order of their
places these are one buffer, which is cut into the texts.

Nulls are empty texts; every input row gives one output row, so repeated and null
keys stay; other columns are left out. No state leaves a task: one that is lost
is run again.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overhaul.llm.common import map_batches

SLICE = 1 << 21  # characters (or ids) handled by one query, unless a single text is longer
SHORT = 64  # bytes from which a word counts as long
WORD_BYTES = 1 << 19  # bytes of new words in one recursive query, unless a single word is longer
STEP_ROWS = 1 << 21  # token rows that the steps of one recursive query may keep
KNOWN = 300_000  # words whose ids a task remembers

# A step contracts the leftmost pair of least rank of every unfinished word; places count a word's tokens.
CONTRACT = """
WITH RECURSIVE step(word, place, token, n) AS (
  SELECT word, place, token, 0::INT FROM seed
  UNION ALL (
  WITH pair AS (
    SELECT a.word, a.place, m.rank FROM step a JOIN step b ON a.word = b.word AND a.place + 1 = b.place
    JOIN merges m ON m.left_right = (a.token::BIGINT << 32 | b.token)),
  best AS (SELECT word, min(rank::BIGINT << 32 | place) AS best FROM pair GROUP BY word),
  hit AS (SELECT word, (best >> 32)::INT AS token, (best & 4294967295)::INT AS place FROM best)
  SELECT s.word, s.place - (s.place > h.place)::INT, CASE WHEN s.place = h.place THEN h.token ELSE s.token END, s.n + 1
  FROM step s JOIN hit h USING (word) WHERE s.place <> h.place + 1 AND s.n < $steps))
SELECT * FROM step
"""

# The same for long words, with the later occurrences of the least pair; places count bytes. Of hits that overlap
# (a run such as aaaa) every second one counts.
CONTRACT_LONG = """
WITH RECURSIVE step(word, place, token, size, n) AS (
  SELECT word, place, token, size, 0::INT FROM seed
  UNION ALL (
  WITH pair AS (
    SELECT a.word, a.place, b.place AS gone, a.size + b.size AS size, m.rank
    FROM step a JOIN step b ON a.word = b.word AND a.place + a.size = b.place
    JOIN merges m ON m.left_right = (a.token::BIGINT << 32 | b.token)),
  least AS (SELECT word, min(rank) AS rank FROM pair GROUP BY word),
  hit AS (SELECT pair.*, lag(gone) OVER run IS DISTINCT FROM place AS fresh, row_number() OVER run AS nr
          FROM pair JOIN least USING (word, rank) WINDOW run AS (PARTITION BY word ORDER BY place)),
  turn AS (SELECT *, nr - max(CASE WHEN fresh THEN nr END) OVER (PARTITION BY word ORDER BY place) AS k FROM hit),
  change AS (SELECT word, place, rank AS token, size FROM turn WHERE k % 2 = 0
             UNION ALL SELECT word, gone, -1, 0 FROM turn WHERE k % 2 = 0)
  SELECT s.word, s.place, coalesce(c.token, s.token), coalesce(c.size, s.size), s.n + 1
  FROM step s SEMI JOIN least USING (word) LEFT JOIN change c ON c.word = s.word AND c.place = s.place
  WHERE s.n < $steps AND c.token IS DISTINCT FROM -1))
SELECT * FROM step
"""

DECODE = """
SELECT i.place, v.bytes FROM ids i JOIN vocabulary v USING (id)
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, as the vocabulary file lists them."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def unicode_pattern(pattern: str) -> str:
    """The pattern with white space as the Unicode property, which is what the tokenizer library means by it."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class _Numbered(dict):
    """Gives every new key the next number."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class Coder:
    """A task's DuckDB with the vocabulary, its merge table and the words found so far."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        self.ranks, self.pattern = read_ranks(path), regex.compile(unicode_pattern(pattern))
        self.db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        self._table("vocabulary", id=np.array(list(self.ranks.values()), np.int32), bytes=pa.array(list(self.ranks), pa.binary()))
        self.letters = None
        self.forget()

    def _prepare(self) -> None:
        """What only encoding needs: the ids of single bytes, and the merge table."""
        self.letters = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a << 32 | b, rank) for token, rank in self.ranks.items() for cut in range(1, len(token))
                 if (a := self.ranks.get(token[:cut])) is not None and (b := self.ranks.get(token[cut:])) is not None]
        keys, ranks = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), ())))
        self._table("merges", left_right=keys, rank=ranks.astype(np.int32))

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS FROM given")
        self.db.unregister("given")

    def forget(self) -> None:
        """Start without known words: ids of word k are ``flat[first[k]:first[k] + size[k]]``."""
        self.words = _Numbered()
        self.flat, self.first, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids begin (one more entry than texts)."""
        found = [self.pattern.findall(t) for t in texts]
        if len(self.words) > KNOWN:
            self.forget()
        before = len(self.words)
        which = np.fromiter(map(self.words.__getitem__, chain.from_iterable(found)), np.int64)
        self._learn([w.encode() for w in islice(self.words, before, None)])
        ends = np.concatenate([[0], np.cumsum(self.size[which])])
        at = np.arange(ends[-1]) + np.repeat(self.first[which] - ends[:-1], self.size[which])
        return self.flat[at], ends[np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)]

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of words: a word that is a token is that token, the others are contracted."""
        known = np.fromiter(map(self.ranks.get, words, repeat(-1)), np.int32, len(words))
        length = np.fromiter(map(len, words), np.int64, len(words))
        size = np.ones(len(words), np.int64)
        where, found = [np.flatnonzero(known >= 0)], [known[known >= 0]]
        for query, some in ((CONTRACT, (known < 0) & (length <= SHORT)), (CONTRACT_LONG, (known < 0) & (length > SHORT))):
            some = np.flatnonzero(some)
            for part in _slices(length[some].tolist(), WORD_BYTES):
                merged = self._merge(query, [words[k] for k in some[part].tolist()])
                size[some[part]] = [len(x) for x in merged]
                where.append(np.repeat(some[part], size[some[part]]))
                found += merged
        order = np.argsort(np.concatenate(where), kind="stable")
        self.flat = np.concatenate([self.flat, np.concatenate(found)[order]])
        self.size = np.concatenate([self.size, size])
        self.first = np.cumsum(self.size) - self.size

    def _merge(self, query: str, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word; every round of the loop goes on from the last step that the round before could keep."""
        if self.letters is None:
            self._prepare()
        length = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), length)
        place = (np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)
        token = self.letters[np.frombuffer(b"".join(words), np.uint8)]
        done, extra = [], {"size": np.ones(len(word), np.int32)}
        while len(word):
            steps = max(1, STEP_ROWS // len(word))
            self._table("seed", word=word, place=place, token=token, **extra)
            rows = self.db.execute(query, {"steps": steps}).fetchnumpy()
            word, place, token, n = (np.asarray(rows[c]) for c in ("word", "place", "token", "n"))
            last = np.zeros(len(words), np.int32)
            np.maximum.at(last, word, n)
            final = np.flatnonzero(n == last[word])
            final = final[np.argsort(word[final].astype(np.int64) << 32 | place[final])]
            go_on = last[word[final]] == steps
            done.append((word[final[~go_on]], token[final[~go_on]]))
            final = final[go_on]
            extra = {"size": np.asarray(rows["size"])[final]} if "size" in rows else {}
            word, place, token = word[final], place[final], token[final]
        word, token = (np.concatenate(x) for x in zip(*done))
        token = token[np.argsort(word, kind="stable")]
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        return [token[a:b] for a, b in zip([0, *ends], ends)]

    def decode(self, ids: np.ndarray, begins: np.ndarray) -> list[bytes]:
        """The bytes of each text, whose ids are ``ids[begins[k]:begins[k + 1]]``."""
        n = int(begins[-1] - begins[0])
        self.db.register("ids", pa.table({"id": ids[begins[0]:begins[-1]], "place": np.arange(n, dtype=np.int32)}))
        out = self.db.sql(DECODE).to_arrow_table().combine_chunks()
        self.db.unregister("ids")
        if out.num_rows < n:
            raise ValueError(f"{n - out.num_rows} ids are not in the vocabulary")
        place = out["place"].to_numpy()
        if (place[1:] < place[:-1]).any():
            out = out.take(pa.array(np.argsort(place)))
        parts = out["bytes"].combine_chunks().cast(pa.large_binary())
        _, offsets, data = parts.buffers()
        at = np.frombuffer(offsets, np.int64)[parts.offset:][begins - begins[0]] if n else np.zeros(len(begins), np.int64)
        raw = memoryview(data) if data else b""
        return [bytes(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _slices(sizes: list[int], room: int):
    """Consecutive slices of items whose sizes add up to about ``room``."""
    first = filled = 0
    for k, size in enumerate(sizes):
        filled += size
        if filled >= room:
            yield slice(first, k + 1)
            first, filled = k + 1, 0
    if first < len(sizes):
        yield slice(first, len(sizes))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def _ids_of(numbers: np.ndarray, begins: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(numbers, pa.int32()))


class _Encode:
    def __init__(self, path: str, pattern: str, key: str):
        self.path, self.pattern, self.key = path, pattern, key

    def __call__(self, batches):
        at = coder(self.path, self.pattern)
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for some in _slices([len(t) for t in texts], SLICE):
                yield {self.key: keys[some], "ids": _ids_of(*at.encode(texts[some]))}


class _Decode:
    def __init__(self, path: str, pattern: str, key: str):
        self.path, self.pattern, self.key = path, pattern, key

    def __call__(self, batches):
        at = coder(self.path, self.pattern)
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1).fill_null([])
            sizes = np.diff(np.asarray(lists.offsets)).tolist()
            for some in _slices(sizes, SLICE):
                part = lists[some]
                begins = np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int64)
                yield {self.key: keys[some], "ids": part,
                       "decoded": pa.array(at.decode(np.asarray(part.flatten()), begins), pa.binary())}


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int): every text by the ranks in ``path``, its words being the matches of ``pattern``."""
    docs = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"))
    return map_batches(docs, _Encode(path, pattern, key), f"{key} bigint, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, ids, decoded (binary): the bytes that the ids stand for; an id without bytes is an error."""
    tokens = tokens.select(F.col(key).cast("long").alias(key), F.col(ids).cast("array<int>").alias("ids"))
    return map_batches(tokens, _Decode(path, pattern, key), f"{key} bigint, ids array<int>, decoded binary")
