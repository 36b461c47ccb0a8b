"""Sum-of-squares online packing of token sequences into training windows.

Each document is its ids plus one closing id. Whole windows are cut off its
front; what is left goes into the fill level that makes the sum of squared
counts of open windows smallest (a new window counts as level 0), which keeps
the levels balanced so that fits keep turning up. Counts per level stand in one
array. Each Spark partition packs its own documents as they stream by, so no
shuffle is needed and a retried task packs the same way.

Memory is bounded: past ``MAX_OPEN`` open windows, and at the end of a
partition, the pieces of all open windows are laid end to end and cut anew into
full windows. What then remains at the end is cut into windows whose lengths
are powers of two, which need no padding.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overhaul.llm.bpe import encoder
from overhaul.llm.common import map_batches

MAX_OPEN = 4096
SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long, sequence_length long")


class Packer:
    """Packs pieces ``(doc_id, start, ids, doc_tokens)`` of one stream of documents."""

    def __init__(self, size: int, first_sequence: int, max_open: int = MAX_OPEN):
        self.size, self.next_sequence, self.max_open = size, first_sequence, max_open
        self.count = np.zeros(size + 1, np.int64)  # open windows by fill level
        self.open: list[list[list]] = [[] for _ in range(size)]  # their pieces
        self.opened = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes):
        n = len(ids) // 4
        for start in range(0, n, self.size):
            piece = (doc_id, start, ids[4 * start:4 * (start + self.size)], n)
            if start + self.size <= n:
                self._close([piece])
            else:
                self._place(piece, n - start)

    def best_level(self, length: int) -> int:
        """The fill level to put a piece on (0: a new window); ties take the fullest."""
        fits = self.size - length
        # Change of the sum of squares: a window leaves level h and joins level h + length.
        join = 2 * self.count[length:] + 1  # by h
        join[fits] = 0  # a full window is closed and counts no more
        cost = join[1:] - 2 * self.count[1:fits + 1] + 1
        cost = np.where(self.count[1:fits + 1] > 0, cost, np.iinfo(np.int64).max)
        if len(cost) == 0:
            return 0
        level = fits - int(np.argmin(cost[::-1]))
        return level if cost[level - 1] <= join[0] else 0

    def _place(self, piece: tuple, length: int):
        level = self.best_level(length)
        window = self.open[level].pop() if level else []
        self.count[level] -= level > 0
        self.opened += level == 0
        window.append(piece)
        if level + length == self.size:
            self.opened -= 1
            self._close(window)
            return
        self.open[level + length].append(window)
        self.count[level + length] += 1
        if self.opened > self.max_open:
            self._recut(last=False)

    def _close(self, window: list[tuple]):
        length, offset = sum(len(p[2]) for p in window) // 4, 0
        for doc_id, start, ids, n in window:
            self.rows.append((doc_id, start, len(ids) // 4, ids, n, self.next_sequence, offset, length))
            offset += len(ids) // 4
        self.next_sequence += 1

    def _recut(self, last: bool):
        """Lay the pieces of all open windows end to end and cut full windows."""
        pieces = [p for level in self.open for window in level for p in window][::-1]
        left = sum(len(p[2]) for p in pieces) // 4
        self.open, self.opened = [[] for _ in range(self.size)], 0
        self.count[:] = 0
        while left >= self.size:
            self._close(self._cut(pieces, self.size))
            left -= self.size
        if last:
            while left:
                part = 1 << (left.bit_length() - 1)
                self._close(self._cut(pieces, part))
                left -= part
        elif left:
            self.open[left].append(self._cut(pieces, left))
            self.count[left], self.opened = 1, 1

    @staticmethod
    def _cut(pieces: list[tuple], length: int) -> list[tuple]:
        window = []
        while length:
            doc_id, start, ids, n = pieces.pop()
            take = min(length, len(ids) // 4)
            if take < len(ids) // 4:
                pieces.append((doc_id, start + take, ids[4 * take:], n))
            window.append((doc_id, start, ids[:4 * take], n))
            length -= take
        return window

    def finish(self):
        self._recut(last=True)

    def taken(self) -> dict:
        """Rows of the windows closed since the last call, as columns."""
        rows, self.rows = self.rows, []
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, closing_id: int = 0) -> DataFrame:
    """Pieces of every document in sequences of at most ``size`` tokens.

    One row per piece: doc_id, start (ids of its document before it), length,
    ids (binary, little-endian unsigned 32-bit), doc_tokens (with the closing
    id), sequence_id, offset in its sequence, sequence_length. A null text is
    empty and packs as its closing id alone; a null doc_id is carried; repeated
    rows are packed each. An empty table gives an empty table. Other columns
    are ignored, whatever their names.
    """
    closing = np.array([closing_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(vocabulary)
        context = TaskContext.get()
        packer = Packer(size, (context.partitionId() if context else 0) << 40)
        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode_batch(b.column("text").to_pylist())):
                packer.add(doc_id, ids + closing)
            yield packer.taken()
        packer.finish()
        yield packer.taken()

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)
