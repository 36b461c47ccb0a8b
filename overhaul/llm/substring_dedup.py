"""Removal of word sequences that an earlier document has, by difference-cover anchors.

A window is ``WINDOW`` consecutive words. Word positions modulo ``PERIOD`` in
``COVER``, a perfect difference set, have this property: for any two positions
there is a shift below ``PERIOD`` that brings both into the cover. So two equal
windows share an anchor, the ``ANCHOR`` words from a cover position, at the same
shift (``PERIOD - 1 + ANCHOR <= WINDOW``), and only six of 31 positions are hashed.

1. Texts with the same words form a class; all but its smallest doc_id repeat it whole.
2. Anchors that occur in two or more different texts are found, and where they are.
3. Matches extend from there: every window around such an anchor is hashed whole
   (96 bits), in the smallest document of its class, and the smallest doc_id of
   each window hash is found. Windows that it precedes are repeats.
4. Words covered by repeats are removed.

Counts are aggregated before they are shuffled, and the joins with them can be
split, so a passage that a third of all documents share is no single task's work.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overhaul.llm.common import join_apart, map_batches, stage
from overhaul.llm.hashing import chunks, window_hashes, word_hashes

WINDOW = 50
PERIOD = 31
ANCHOR = 20
# A perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
_COVERED = np.isin(np.arange(PERIOD), COVER)
SECOND_SEED = 0xD6E8FEB86659FD93


def text_words(texts: list[str | None]):
    """For each text: its word hashes."""
    data = [(t or "").encode() for t in texts]
    for a, b in chunks(data):
        words, bounds = word_hashes(data[a:b])
        for i, j in zip(bounds, bounds[1:]):
            yield words[i:j]


def text_key(words: np.ndarray) -> int:
    """One number for a whole sequence of words; texts count as copies only if they agree in text_rest, too."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(words.tobytes())).astype(np.int64))


def anchors_at(words: np.ndarray) -> np.ndarray:
    """Cover positions whose anchor lies in the text; none if the text has no window."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64)
    at = np.arange(len(words) - ANCHOR + 1)
    return at[_COVERED[at % PERIOD]]


def _anchors(docs: DataFrame, where: bool) -> DataFrame:
    """anchor, text_key and, if asked for, the position of every anchor."""

    def run(batches):
        for b in batches:
            hashes, keys, places = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int64)]
            for words in text_words(b.column("text").to_pylist()):
                at = anchors_at(words)
                h = window_hashes(words, at, ANCHOR)
                if not where:
                    h = np.unique(h)
                hashes.append(h)
                places.append(at)
                keys.append(np.full(len(h), text_key(words) if len(h) else 0))
            out = {"anchor": np.concatenate(hashes).view(np.int64), "text_key": np.concatenate(keys or [np.zeros(0, np.int64)])}
            yield out | ({"place": np.concatenate(places).astype(np.int32)} if where else {})

    return map_batches(docs, run, "anchor long, text_key long" + ", place int" * where)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text_rest, n_words of every row; text_rest is another 64 bits, of the words' own bytes."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            keys, sizes = [], []
            for words in text_words(texts):
                keys.append(text_key(words))
                sizes.append(len(words))
            rest = [xxhash.xxh3_64_intdigest(b" ".join((t or "").encode().split())) - (1 << 63) for t in texts]
            yield {"doc_id": b.column("doc_id"), "text_key": keys, "text_rest": rest, "n_words": sizes}

    return map_batches(docs, run, "doc_id long, text_key long, text_rest long, n_words long")


def windows_around(words: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Positions of the windows that hold one of these anchors at a shift below PERIOD."""
    edge = np.zeros(len(words) + 2, np.int64)
    np.add.at(edge, np.maximum(anchors - (PERIOD - 1), 0), 1)
    np.add.at(edge, anchors + 1, -1)
    near = np.cumsum(edge)[:max(0, len(words) - WINDOW + 1)]
    return np.flatnonzero(near)


def _windows(hits: DataFrame) -> DataFrame:
    """first_hash, second_hash, doc_id, text_key, place of every window to judge."""

    def run(batches):
        for b in batches:
            columns = [[np.zeros(0, np.int64)] for _ in range(5)]
            rows = zip(b.column("doc_id").to_pylist(), b.column("text_key").to_pylist(), b.column("places").to_pylist(),
                       text_words(b.column("text").to_pylist()))
            for doc_id, key, places, words in rows:
                if text_key(words) != key:  # another row of the same doc_id
                    continue
                at = windows_around(words, np.array(places, np.int64))
                first = window_hashes(words, at, WINDOW).view(np.int64)
                second = window_hashes(words, at, WINDOW, SECOND_SEED).view(np.int64) >> 32
                for column, part in zip(columns, (first, second, np.full(len(at), doc_id), np.full(len(at), key), at)):
                    column.append(part)
            yield dict(zip(("first_hash", "second_hash", "doc_id", "text_key", "place"), map(np.concatenate, columns)))

    return map_batches(hits, run, "first_hash long, second_hash int, doc_id long, text_key long, place int")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, marks: for each document with repeats, its texts' keys with the places of repeated windows.

    ``marks`` is an array of (text_key, places); places is null if the whole
    text repeats an earlier document's.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = stage(_texts(docs).where(F.col("n_words") >= WINDOW).drop("n_words"), "texts")
    classes = texts.groupBy("text_key", "text_rest").agg(F.min("doc_id").alias("first_doc"))
    copies = join_apart(texts, classes, ["text_key", "text_rest"]).where("doc_id > first_doc").select("doc_id", "text_key").distinct()

    shared = (_anchors(docs, where=False).groupBy("anchor").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high"))
              .where("low < high").select("anchor"))
    places = stage(join_apart(_anchors(docs, where=True), shared, ["anchor"]).groupBy("text_key")
                   .agg(F.collect_set("place").alias("places")), "places")
    hits = places.join(classes, "text_key").select(F.col("first_doc").alias("doc_id"), "text_key", "places")
    windows = _windows(stage(docs.join(hits, "doc_id"), "hits"))
    hashes = ["first_hash", "second_hash"]
    first = (windows.groupBy(*hashes).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
             .where("first_doc < last_doc").select(*hashes, "first_doc"))
    later = (join_apart(windows, first, hashes).where("doc_id > first_doc").groupBy("doc_id", "text_key")
             .agg(F.collect_set("place").alias("places")))
    marks = later.unionByName(copies.withColumn("places", F.lit(None).cast("array<int>")))
    return stage(marks.groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "places")).alias("marks")), "marks")


def removed_words(n: int, places: list[int] | None) -> np.ndarray:
    """Which of n words the windows at these places cover; all if there is no list."""
    if places is None:
        return np.ones(n, bool)
    edge = np.zeros(n + 1, np.int64)
    at = np.unique(np.array(places, np.int64))
    edge[at] += 1
    np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge[:n]) > 0


def cut(text: str, marks: list[dict] | None) -> tuple[int, int, str]:
    """Word count, removed words, and the kept words joined by one space."""
    data = text.encode()
    words = data.split()
    for mark in marks or []:
        key, places = mark["text_key"], mark["places"]
        if len(words) >= WINDOW and text_key(next(text_words([text]))) == key:
            gone = removed_words(len(words), places)
            kept = [w for w, g in zip(words, gone.tolist()) if not g]
            return len(words), len(words) - len(kept), b" ".join(kept).decode()
    return len(words), 0, b" ".join(words).decode()


def deduplicate(docs: DataFrame, rows: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row; with ``rows``, also the whole input row as ``row``.

    A word is removed if a window that covers it also starts in a document
    with a smaller doc_id; windows are judged on the input. A null text has no
    words. A null doc_id comes before and after none: it keeps all its words
    and takes none from others. Repeated rows get equal results; rows of one
    doc_id with different texts do not cut each other. Other columns are
    ignored, whatever their names; an empty table gives an empty table.
    """
    marks = repeats(docs).select(F.col("doc_id").alias("marked_id"), "marks")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.struct("*").alias("row")] if rows else []))

    def run(batches):
        for b in batches:
            some = [cut(t or "", m) for t, m in zip(b.column("text").to_pylist(), b.column("marks").to_pylist())]
            names = ("n_words", "n_removed", "kept_text")
            out = {"doc_id": b.column("doc_id")} | (dict(zip(names, zip(*some))) if some else {n: [] for n in names})
            yield out | ({"row": b.column("row")} if rows else {})

    joined = own.join(marks, own["doc_id"] == marks["marked_id"], "left").drop("marked_id")
    return map_batches(joined, run, "doc_id long, n_words long, n_removed long, kept_text string", "row" if rows else None)


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS key
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM words WHERE len(w) >= 50)),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM windows GROUP BY key),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS pos
  FROM windows JOIN firsts USING (key) WHERE first_doc < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
  FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)"""
