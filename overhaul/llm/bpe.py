"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding.

The text arrives in chunks. It is cut into pre-tokens (runs of letters, digits,
other symbols, white space), each of which is merged on its own. Inside a
pre-token of any length, a token is emitted once no later byte can change it:

*Sufficient lookahead.* A merge ``(u, v)`` of the text read so far fails in a
longer text only if a piece on the right spine of ``v`` is taken earlier, by a
rule ``(a, b)`` that ranks before the rule that uses ``a``; whether ``b`` is
there depends in turn on its own right spine. Ranks fall along such a chain, so
its longest total length of the ``b`` is found in one pass over the rules in
rank order. A boundary with that many bytes behind it is final.

Memory is one chunk, the unfinished tail, a buffer of a few lookaheads and two
bounded caches of finished pieces (two generations, so frequent ones stay).
Decoding joins token bytes and runs them through an incremental UTF-8 machine
that holds back an unfinished character; bytes that are not UTF-8 become U+FFFD.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overhaul.llm.common import map_batches
from overhaul.llm.hashing import letter_run_hashes

CHUNK = 1 << 16
CACHE = 50_000  # pieces in each of two generations
SHORT = 48  # bytes of a pre-token merged side by side with others; characters of a cached piece
LANE_TEXT = 1 << 20  # characters from which a text is streamed alone
LANE_BATCH = 1 << 22  # characters of texts handled side by side
LONG_TAIL = 4096  # characters without a safe cut before the tail itself is streamed

# The pre-token pattern of the vocabulary, white space spelled out
# as the Unicode property.
PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# A single space between two visible characters always begins a pre-token.
_UNSAFE = re.compile(r" (?=\s)|(?<=\s) ")
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> dict[str, int]:
    """The visible letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """Merge rules, token bytes and the sufficient lookahead of one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.token_bytes = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: s.encode() for s, i in self.specials.items()}
        self.byte_ids = [0] * 256
        for c, b in letters.items():
            self.byte_ids[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.no_rule = len(merges)
        self.rank = {vocab[a] << 32 | vocab[b]: k for k, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self._hash_rules()
        self._made = np.array(self.made, np.int64)
        self.lookahead = self._sufficient_lookahead([(vocab[a], vocab[b]) for a, b in merges])
        self.special_pattern = (
            regex.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
            if self.specials else None
        )
        self.special_room = max(map(len, self.specials), default=1) - 1
        self.pretoken = regex.compile(PRETOKEN)

    def _sufficient_lookahead(self, rules: list[tuple[int, int]]) -> int:
        reach = {}  # token -> longest doubt to its right, from the rules so far that take it as their left part
        doubt = {}  # token -> doubt inside the rule that makes it
        longest = 0
        for (a, b), made in zip(rules, self.made):
            d = max(reach.get(b, 0), doubt.get(b, 0))
            doubt[made] = max(d, doubt.get(made, 0))
            reach[a] = max(reach.get(a, 0), len(self.token_bytes[b]) + d)
            longest = max(longest, reach[a])
        return longest

    def merge(self, data: bytes) -> list[int]:
        """Tokens of one finished run of bytes: lowest rank first, leftmost first."""
        rank, made, none = self.rank.get, self.made, self.no_rule
        ids = [self.byte_ids[b] for b in data]
        ranks = [rank(ids[i] << 32 | ids[i + 1], none) for i in range(len(ids) - 1)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], none)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], none)
        return ids


    def _hash_rules(self):
        """The rules by pair in an open hash table, for lookups of whole arrays."""
        self._bits = max(4, (8 * len(self.rank)).bit_length() - 1)
        self._keys, self._ranks = np.full(1 << self._bits, -1, np.int64), np.full(1 << self._bits, self.no_rule, np.int32)
        left = np.array(list(self.rank), np.int64)
        ranks = np.array(list(self.rank.values()), np.int32)
        slot = self._slot(left)
        while len(left):
            _, one = np.unique(slot, return_index=True)
            one = one[self._keys[slot[one]] == -1]
            self._keys[slot[one]], self._ranks[slot[one]] = left[one], ranks[one]
            rest = np.ones(len(left), bool)
            rest[one] = False
            left, ranks, slot = left[rest], ranks[rest], slot[rest] + 1 & (1 << self._bits) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        slot = self._slot(key)
        found = self._keys[slot]
        out = np.where(found == key, self._ranks[slot], self.no_rule)
        more = np.flatnonzero((found != key).ravel() & (found != -1).ravel())
        slots, keys, flat = slot.ravel(), key.ravel(), out.ravel()
        while len(more):
            slots[more] = slots[more] + 1 & (1 << self._bits) - 1
            found = self._keys[slots[more]]
            hit = found == keys[more]
            flat[more[hit]] = self._ranks[slots[more[hit]]]
            more = more[~hit & (found != -1)]
        return flat.reshape(key.shape)

    def merge_lanes(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """``merge`` of many runs ``data[start:start + size]`` side by side.

        Runs of one size form a matrix; each round merges the best pair of
        every row, so all rows that go on lose one column. Returns all ids in
        one array, and where each run's ids start and how many they are.
        """
        flat, filled = [], 0
        first, count = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        letters = np.array(self.byte_ids, np.int64)
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1))
        for rows in np.split(order, cuts[1:]) if len(order) else []:
            w = int(sizes[rows[0]])
            if w > SHORT:
                for k in rows.tolist():
                    run = RunMerger(self)
                    raw = data[starts[k]:starts[k] + w].tobytes()
                    ids = np.frombuffer(run.feed(raw) + run.finish(), "<u4")
                    flat.append(ids)
                    first[k], count[k] = filled, len(ids)
                    filled += len(ids)
                continue
            ids = letters[data[starts[rows, None] + np.arange(w)]]
            ranks = self._rank_of(ids[:, :-1], ids[:, 1:])
            while len(rows):
                lane = np.arange(len(rows))
                if w > 1:
                    at = ranks.argmin(1)
                    best = ranks[lane, at]
                    go = best < self.no_rule
                else:
                    go = np.zeros(len(rows), bool)
                if not go.all():
                    stop = ~go
                    done = rows[stop]
                    flat.append(ids[stop].ravel())
                    first[done], count[done] = filled + w * np.arange(len(done)), w
                    filled += w * len(done)
                    rows = rows[go]
                    if not len(rows):
                        break
                    ids, ranks, at, best, lane = ids[go], ranks[go], at[go], best[go], lane[:len(rows)]
                ids[lane, at] = self._made[best]
                ids = ids[np.arange(w) != at[:, None] + 1].reshape(len(rows), w - 1)
                ranks = ranks[np.arange(w - 1) != at[:, None]].reshape(len(rows), w - 2)
                w -= 1
                some = np.flatnonzero(at < w - 1)
                i = at[some]
                ranks[some, i] = self._rank_of(ids[some, i], ids[some, i + 1])
                some = np.flatnonzero(at > 0)
                i = at[some]
                ranks[some, i - 1] = self._rank_of(ids[some, i - 1], ids[some, i])
        return np.concatenate(flat or [np.zeros(0)]).astype("<u4"), first, count


LETTER, NUMBER, OTHER, WHITE, BREAK = range(5)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The pattern's class of each code point; BREAK stands between texts."""
    out = np.full(0x110001, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, which in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(which, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a:b + 1] = kind
    out[0xD800:0xE000] = OTHER
    out[0x110000] = BREAK
    return out


def pretoken_bounds(texts: list[str]):
    """Bytes of the texts, each followed by one zero byte, and where their pre-tokens begin and end.

    What the pattern does one match at a time follows from the classes of
    neighbours: a run of one class is a pre-token; a space before a visible run
    joins it; the last of several white characters stands alone or joins; an
    ending after an apostrophe that starts a run is cut off.
    """
    joined = "\0".join(texts) + "\0"
    char = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
    breaks = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind = _classes()[char]
    kind[breaks] = BREAK
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[0], before[1:], after[-1], after[:-1] = BREAK, kind[:-1], BREAK, kind[1:]
    spaced = np.zeros(len(char), bool)
    spaced[1:] = (char[:-1] == 32) & (before[1:] == WHITE)
    white, seen = kind == WHITE, kind < WHITE
    start = (seen & (before != kind) & ~spaced) | (white & ((before != WHITE) | (after < WHITE))) | (kind == BREAK)
    mark = np.flatnonzero((char == 39) & start & (kind == OTHER))
    if len(mark):
        padded = np.concatenate([char, [0, 0]])
        one, two = padded[mark + 1], padded[mark + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(mark), bool)
        for x, y in ("re", "ve", "ll"):
            long |= (one == ord(x)) & (two == ord(y))
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
    width = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
    at = np.cumsum(width) - width
    begins = at[start]
    ends = np.append(begins[1:], at[-1] + 1)
    keep = kind[start] != BREAK
    return np.frombuffer(joined.encode(), np.uint8), begins[keep], ends[keep]


def _distinct(data: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """One of each distinct run, and for every run which one it equals: runs of equal hash are compared byte by byte."""
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, distinct, which = np.unique(letter_run_hashes(data, begins, ends), return_index=True, return_inverse=True)
    size, like = ends - begins, distinct[which]
    same = size == size[like]
    if same.all():
        total = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        equal = data[np.repeat(begins - total, size) + step] == data[np.repeat(begins[like] - total, size) + step]
        same = np.add.reduceat(~equal, total) == 0
    if not same.all():
        runs = [data[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist())]
        first = {}
        for k, run in enumerate(runs):
            first.setdefault(run, k)
        distinct = np.array(list(first.values()), np.int64)
        number = {run: k for k, run in enumerate(first)}
        which = np.array([number[run] for run in runs], np.int64)
    return distinct, which


class _Cache:
    """Bounded: when the young generation is full it becomes the old one."""

    def __init__(self):
        self.young, self.old = {}, {}

    def get(self, key):
        return self.young.get(key)

    def find(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value):
        if len(self.young) >= CACHE:
            self.young, self.old = {}, self.young
        self.young[key] = value


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class RunMerger:
    """Merges one pre-token of unbounded length, fed in parts."""

    def __init__(self, pairs: BytePairs):
        self.pairs, self.buffer = pairs, b""
        self.block = max(4 * pairs.lookahead, 512)

    def feed(self, data: bytes) -> bytes:
        out = []
        for i in range(0, len(data), self.block):
            self.buffer += data[i:i + self.block]
            if len(self.buffer) > self.pairs.lookahead:
                out.append(self._stable(len(self.buffer) - self.pairs.lookahead))
        return b"".join(out)

    def _stable(self, limit: int) -> bytes:
        ids, at = [], 0
        for token in self.pairs.merge(self.buffer):
            if at + len(self.pairs.token_bytes[token]) > limit:
                break
            at += len(self.pairs.token_bytes[token])
            ids.append(token)
        self.buffer = self.buffer[at:]
        return _packed(ids)

    def finish(self) -> bytes:
        out, self.buffer = _packed(self.pairs.merge(self.buffer)), b""
        return out


class Encoder:
    """Encodes texts; keeps caches of pieces between them."""

    def __init__(self, pairs: BytePairs):
        self.pairs, self.pieces, self.pretokens = pairs, _Cache(), _Cache()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        stream = TextStream(self)
        return b"".join([stream.feed(text[i:i + CHUNK]) for i in range(0, len(text or ""), CHUNK)] + [stream.finish()])

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of several texts; their distinct pre-tokens are merged side by side."""
        texts = [t or "" for t in texts]
        apart = [len(t) > LANE_TEXT or any(s in t for s in self.pairs.specials) for t in texts]
        out: list[bytes] = [self.encode(t) if alone else b"" for t, alone in zip(texts, apart)]
        some, size = [], 0
        for k, alone in enumerate(apart):
            if not alone:
                some.append(k)
                size += len(texts[k])
            if some and (size > LANE_BATCH or k == len(texts) - 1):
                for j, ids in zip(some, self._in_lanes([texts[j] for j in some])):
                    out[j] = ids
                some, size = [], 0
        if some:
            for j, ids in zip(some, self._in_lanes([texts[j] for j in some])):
                out[j] = ids
        return out

    def _in_lanes(self, texts: list[str]) -> list[bytes]:
        data, begins, ends = pretoken_bounds(texts)
        distinct, which = _distinct(data, begins, ends)
        flat, first, count = self.pairs.merge_lanes(data, begins[distinct], (ends - begins)[distinct])
        count_of = count[which]
        total = np.concatenate([[0], np.cumsum(count_of)])
        ids = flat[np.repeat(first[which] - total[:-1], count_of) + np.arange(total[-1])]
        sizes = np.array([len(t.encode()) + 1 for t in texts])
        cut = total[np.searchsorted(begins, np.concatenate([[0], np.cumsum(sizes)]))].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cut, cut[1:])]

    def words(self, words: list[str]) -> bytes:
        """Ids of words that each follow a single space."""
        found = list(map(self.pieces.get, words))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    word = words[i]
                    ids = self.pieces.find(word)
                    if ids is None:
                        ids = self.piece(" " + word)
                        if len(word) <= SHORT:
                            self.pieces.put(word, ids)
                    found[i] = ids
        return b"".join(found)

    def piece(self, text: str) -> bytes:
        """Ids of a piece that ends where a pre-token ends."""
        parts = self.pairs.special_pattern.split(text) if self.pairs.special_pattern else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(_packed([self.pairs.specials[part]]))
            else:
                out.extend(map(self.pretoken, self.pairs.pretoken.findall(part)))
        return b"".join(out)

    def pretoken(self, text: str) -> bytes:
        ids = self.pretokens.find(text)
        if ids is None:
            data = text.encode()
            if len(data) <= 256:
                ids = _packed(self.pairs.merge(data))
            else:
                run = RunMerger(self.pairs)
                ids = run.feed(data) + run.finish()
            if len(text) <= SHORT:
                self.pretokens.put(text, ids)
        return ids


class TextStream:
    """One text, fed in chunks cut anywhere."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.tail, self.at_start = encoder, "", True
        self.run = None  # merger of a pre-token that began in text already passed on

    def feed(self, chunk: str) -> bytes:
        self.tail += chunk
        out = [self._go_on_with_run()] if self.run else []
        if not self.run:
            words = self.tail.split(" ") if not _UNSAFE.search(self.tail) else _SAFE.split(self.tail)
            if len(words) > 1 and words[-1] and not words[-1][0].isspace():
                out.append(self._words(words[:-1]))
                self.tail = words[-1]
            elif len(words) > 2:
                out.append(self._words(words[:-2]))
                self.tail = " ".join(words[-2:])
            while not self.run and len(self.tail) > LONG_TAIL and (ids := self._part_of_tail()) is not None:
                out.append(ids)
        return b"".join(out)

    def finish(self) -> bytes:
        out = [self._go_on_with_run(last=True)] if self.run else []
        if self.tail:
            out.append(self._words(_SAFE.split(self.tail)))
            self.tail = ""
        return b"".join(out)

    def _words(self, words: list[str]) -> bytes:
        if not self.at_start:
            return self.encoder.words(words)
        self.at_start = False
        return self.encoder.piece(words[0]) + self.encoder.words(words[1:])

    def _part_of_tail(self) -> bytes | None:
        """Pass on the finished pre-tokens of a long tail, and open a run for the last."""
        text = ("" if self.at_start else " ") + self.tail
        pairs = self.encoder.pairs
        special = pairs.special_pattern.search(text) if pairs.special_pattern else None
        if special:
            self.at_start, self.tail = True, text[special.end():]
            return self.encoder.piece(text[:special.end()])
        room = pairs.special_room + 3
        end, ids = 0, []
        for m in pairs.pretoken.finditer(text):
            if m.end() + room > len(text):
                break
            end = m.end()
            ids.append(self.encoder.pretoken(m[0]))
        if end:
            self.at_start, self.tail = True, text[end:]
            return b"".join(ids)
        kind = regex.match(r" ?(?:(\p{L})|(\p{N})|([^\p{White_Space}\p{L}\p{N}]))|(\p{White_Space})", text)
        if kind is None:
            return None
        # The fixed classes of the pattern, by which a run goes on.
        self.run = RunMerger(pairs), regex.compile(
            [r"\p{L}*", r"\p{N}*", r"[^\p{White_Space}\p{L}\p{N}]*", r"\p{White_Space}*"][kind.lastindex - 1])
        self.at_start, self.tail = True, text
        ids = b""
        if kind.lastindex < 4 and text[0] == " ":
            ids, self.tail = self.run[0].feed(b" "), text[1:]
        return ids + self._go_on_with_run()

    def _go_on_with_run(self, last: bool = False) -> bytes:
        merger, same = self.run
        pairs = self.encoder.pairs
        special = pairs.special_pattern.search(self.tail) if pairs.special_pattern else None
        stop = special.start() if special else len(self.tail)
        end = min(same.match(self.tail).end(), stop)
        white = same.pattern.startswith(r"\p{W")
        sure = len(self.tail) - pairs.special_room - 1
        if not special and not last and end > sure:  # it may go on, or a special token may begin in it
            sure = max(0, sure)
            out = merger.feed(self.tail[:sure].encode())
            self.tail = self.tail[sure:]
            return out
        if white and end < stop and end:  # the last white space goes with what follows
            end -= 1
        out = merger.feed(self.tail[:end].encode()) + merger.finish()
        self.tail, self.run, self.at_start = self.tail[end:], None, True
        return out


class Decoder:
    """Token ids to text, in parts; holds back the bytes of an unfinished character."""

    def __init__(self, token_bytes: dict[int, bytes]):
        self.token_bytes = token_bytes
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        try:
            data = b"".join(map(self.token_bytes.__getitem__, ids))
        except KeyError:  # ids outside the vocabulary stand for nothing
            data = b"".join(self.token_bytes.get(i, b"") for i in ids)
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, once for each Python worker."""
    return Encoder(BytePairs(path))


def unpack(data: bytes) -> array:
    ids = array("I", data)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


def decode_ids(path: str, data: bytes) -> str:
    decoder = Decoder(encoder(path).pairs.token_bytes)
    parts = [decoder.feed(unpack(data[i:i + 4 * CHUNK])) for i in range(0, len(data), 4 * CHUNK)]
    return "".join(parts) + decoder.finish()


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) of every whole text.

    One row per input row, in any order; repeated rows repeat. A null text is
    an empty one (no ids); a null doc_id is carried. Other columns are ignored,
    whatever their names. An empty table gives an empty table.
    """

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            yield {"doc_id": b.column("doc_id"), "ids": enc.encode_batch(b.column("text").to_pylist())}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids binary")


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids, decoded: the text of each row's ids (null ids: empty text)."""

    def run(batches):
        for b in batches:
            yield {"doc_id": b.column("doc_id"), "ids": b.column("ids"),
                   "decoded": [decode_ids(vocabulary, x or b"") for x in b.column("ids").to_pylist()]}

    return map_batches(tokens.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded string")
