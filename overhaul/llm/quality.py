"""Line quality: a linear-chain CRF marks lines as content or boilerplate.

A document's lines are labelled together: each line has features of its own,
neighbouring labels have weights, and Viterbi decoding finds the best labelling.
A document is kept if content lines hold at least half of its words, and if it
passes two base rules (enough words, little repetition).

The CRF is fitted on labelled documents: every line takes its document's label,
so the weights learn which lines are typical of rejected documents.
"""

from __future__ import annotations

import re
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overhaul.llm.common import map_batches

MIN_WORDS = 50
CONTENT_SHARE = 0.5
# The CRF is fitted on this many labelled documents of each quality at most,
# those whose ids hash lowest.
TRAIN_DOCS = 1500
TRAIN_LINES = 64  # lines of one training sequence; longer documents give several
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
_LINK = re.compile(r"https?://|www\.|@")
_DIGITS = re.compile(r"[0-9]+")
_LOWER = re.compile(r"[^\W\d_A-Z]")

FEATURES = (
    "bias", "no_end", "short", "tiny", "upper_line", "upper_words", "symbol_some", "symbol_many", "bars", "shouts",
    "repeated_line", "few_kinds", "doubled", "long_words", "short_words", "digits", "links", "no_lower",
)


def words_of(text: str) -> list[bytes]:
    """Maximal runs without ASCII white space, as UTF-8 (bytes.split splits on exactly those six)."""
    return text.encode().split()


def line_features(words: list[bytes], line: str, seen: bool, symbols: int) -> list[float]:
    """Features of one line that has words, in the order of FEATURES."""
    n = len(words)
    upper = sum(map(bytes.isupper, words))
    digits = sum(map(len, _DIGITS.findall(line)))
    mean = len(line) / n
    return [
        1.0, float(line.rstrip()[-1:] not in ".!?:;»\"')"), float(n < 8), float(n < 3),
        float(n > 2 and upper > 0.8 * n), upper / n, min(1.0, symbols / n), float(symbols > 0.3 * n),
        min(1.0, line.count("|") / n), min(1.0, line.count("!") / n), float(seen),
        float(n > 9 and len(set(words)) < 0.4 * n), sum(map(bytes.__eq__, words, words[1:])) / n,
        float(mean > 14), float(mean < 3), min(1.0, digits / len(line)),
        float(_LINK.search(line) is not None), float(_LOWER.search(line) is None),
    ]


def document_lines(text: str):
    """Feature rows and words of the lines that have words, all words, and how many lines repeat an earlier one."""
    rows, sizes, every, seen, repeated = [], [], [], set(), 0
    clean = not any(map(text.count, SYMBOLS))
    for line in text.split("\n"):
        words = words_of(line)
        if words:
            again = line in seen
            repeated += again
            seen.add(line)
            rows.append(line_features(words, line, again, 0 if clean else sum(map(line.count, SYMBOLS))))
            sizes.append(len(words))
            every += words
    return rows, sizes, every, repeated


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, count()), np.int64, n)
    if n >= 1 << 20:
        ids = np.unique(ids, return_inverse=True)[1]
    pair = ids[:-1] * n + ids[1:]
    if n >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, which, times = np.unique(pair[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= again
    return int(covered.sum())


class LineCrf:
    """Weights of a linear-chain CRF with labels 0 (boilerplate) and 1 (content)."""

    def __init__(self, weights: np.ndarray, links: np.ndarray):
        self.weights, self.links = weights, links  # (features,) for label 1 against 0; (2, 2) by previous, next

    def viterbi(self, rows: list[list[float]]) -> list[int]:
        """The best labelling; a tie goes to content."""
        if not rows:
            return []
        scores = (np.asarray(rows) @ self.weights).tolist()
        (l00, l01), (l10, l11) = self.links.tolist()
        zero, one = 0.0, scores[0]
        back = []
        for s in scores[1:]:
            from0, from1 = one + l10 >= zero + l00, one + l11 >= zero + l01
            back.append((from0, from1))
            zero, one = (one + l10 if from0 else zero + l00), (one + l11 if from1 else zero + l01) + s
        label = int(one >= zero)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    def keeps(self, rows, sizes) -> bool:
        """Content lines hold at least CONTENT_SHARE of the words."""
        content = sum(n for n, label in zip(sizes, self.viterbi(rows)) if label)
        return content >= CONTENT_SHARE * sum(sizes)


def _log_sum(a, b):
    return np.logaddexp(a, b)


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], steps: int = 150, ridge: float = 1e-3) -> LineCrf:
    """Maximum likelihood by gradient ascent; forward-backward over all sequences side by side."""
    n, t = len(sequences), max(map(len, sequences))
    x, y, on = np.zeros((n, t, len(FEATURES))), np.zeros((n, t), int), np.zeros((n, t), bool)
    for k, (rows, marks) in enumerate(zip(sequences, labels)):
        x[k, :len(rows)], y[k, :len(rows)], on[k, :len(rows)] = rows, marks, True
    total = on.sum()
    both = on[:, 1:]
    seen_links = np.zeros((2, 2))
    np.add.at(seen_links, (y[:, :-1][both], y[:, 1:][both]), 1)
    seen_weights = (x * (y * on)[..., None]).sum((0, 1))
    w, links = np.zeros(len(FEATURES)), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        emit = np.zeros((n, t, 2))
        emit[..., 1] = x @ w
        ahead, behind = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        ahead[:, 0] = emit[:, 0]
        for k in range(1, t):
            go = ahead[:, k - 1, :, None] + links
            ahead[:, k] = np.where(on[:, k, None], _log_sum(go[:, 0], go[:, 1]) + emit[:, k], ahead[:, k - 1])
        norm = _log_sum(ahead[:, -1, 0], ahead[:, -1, 1])
        for k in range(t - 2, -1, -1):
            go = links + (emit[:, k + 1] + behind[:, k + 1])[:, None, :]
            behind[:, k] = np.where(on[:, k + 1, None], _log_sum(go[..., 0], go[..., 1]), 0.0)
        one = np.exp(ahead[..., 1] + behind[..., 1] - norm[:, None]) * on
        pairs = np.exp(ahead[:, :-1, :, None] + links + (emit + behind)[:, 1:, None, :] - norm[:, None, None, None])
        pairs = (pairs * both[..., None, None]).sum((0, 1))
        g = np.concatenate([seen_weights - (x * one[..., None]).sum((0, 1)), (seen_links - pairs).ravel()]) / total
        g -= ridge * np.concatenate([w, links.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, links = w + move[:len(w)], links + move[len(w):].reshape(2, 2)
    return LineCrf(w, links)


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> LineCrf | None:
    """Fit on at most ``limit`` labelled documents of each quality; None without both qualities."""
    marks = (labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("mark"))
             .where("doc_id IS NOT NULL AND mark IN (0, 1)").distinct())
    chosen = None
    for mark in (0, 1):
        some = marks.where(F.col("mark") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "mark").distinct()
    # At most 2 * limit texts, in an order of their own so that the fit is repeatable.
    rows = rows.orderBy(F.xxhash64("text"), "mark").limit(2 * limit).toLocalIterator()
    sequences, known = [], []
    for text, mark in rows:
        lines = document_lines(text)[0]
        for k in range(0, len(lines), TRAIN_LINES):
            sequences.append(np.array(lines[k:k + TRAIN_LINES]))
            known.append(np.full(len(sequences[-1]), mark))
    if len({int(k[0]) for k in known}) < 2:
        return None
    return fit(sequences, known)


def score(docs: DataFrame, crf: LineCrf | None, rows: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_words, kept.

    One row per input row; with ``rows``, the whole input row comes along as ``row``. A null text is empty: no words, so base_failed. A
    null doc_id is carried; repeated rows are judged each. Without a CRF (no
    labels of both kinds) every line is content. Other columns are ignored,
    whatever their names; an empty table gives an empty table.
    """

    def judge(text):
        text = text or ""
        features, sizes, words, repeated_lines = document_lines(text)
        n = len(words)
        again = repeated_words(words)
        failed = n < MIN_WORDS or 100 * again > 50 * n
        marks = crf.viterbi(features) if crf else [1] * len(features)
        content = sum(size for size, mark in zip(sizes, marks) if mark)
        return (n, len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), repeated_lines, again,
                failed, content, not failed and content >= CONTENT_SHARE * n)

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_words", "kept"]

    def run(batches):
        for b in batches:
            found = [judge(t) for t in b.column("text").to_pylist()]
            out = {"doc_id": b.column("doc_id")} | (dict(zip(names, zip(*found))) if found else {n: [] for n in names})
            yield out | ({"row": b.column("row")} if rows else {})

    own = docs.select(F.col("doc_id").cast("long"), "text", *([F.struct("*").alias("row")] if rows else []))
    return map_batches(own, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                       "n_repeat_words long, base_failed boolean, content_words long, kept boolean", "row" if rows else None)
