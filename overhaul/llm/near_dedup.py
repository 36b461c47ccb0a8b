"""Near-duplicate groups from bottom-k sketches.

One hash function serves all: a document's set is its distinct five-word
shingles as hashes, its sketch the ``SKETCH`` smallest of them.

1. Documents with equal sets form a class and go on as one, under the smallest
   doc_id. Classes whose sketches share too few values with anything are done.
2. Inverted lists of retained values (each class under its ``KEYS`` smallest
   values that occur elsewhere) generate overlaps. A list is not paired with
   itself: all its classes are compared with one leader, the class that shares
   most. The union sketch of a pair estimates its similarity and drops clear
   misses; the full sets of the others are intersected.
3. Components of those links are formed. In lists whose classes are then in
   different components, the classes outside the leader's component are compared
   with all others of the list, in pairs of blocks, by full sets; each block
   task returns only links that join components.
4. Components of all links give the groups.

Two sets of similarity 0.85 miss each other in the sketches with a chance below
1e-7 (fewer than ``SHARED`` of 32 values in common) plus 1e-8 (none among the
first ten); every link that is made is confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overhaul.llm.common import join_apart, map_batches, stage
from overhaul.llm.components import components
from overhaul.llm.hashing import chunks, few_hashes, word_hashes

SHINGLE = 5
PERCENT = 85  # links have 100 * intersection >= PERCENT * union
SKETCH = 32
SHARED = 14  # values that sketches of similar sets have in common at least, if the union has SKETCH values
KEYS = 10
BLOCK = 1024  # classes in a block of a long list,
BLOCK_VALUES = 1 << 20  # and shingles of all of them, on average


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z lower-cased, fewer words than five as one shingle."""
    out = []
    data = [(t or "").encode().lower() for t in texts]  # bytes.lower changes A-Z only
    for a, b in chunks(data):
        words, bounds = word_hashes(data[a:b])
        counts = np.diff(bounds)
        starts = np.maximum(counts - SHINGLE + 1, (counts > 0).astype(np.int64))
        first = np.repeat(bounds[:-1] - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
        last = np.minimum(first + SHINGLE, np.repeat(bounds[1:], starts))
        hashes = few_hashes(words, first, last, SHINGLE) if len(first) else np.zeros(0, np.uint64)
        out += [np.unique(h) for h in np.split(hashes, np.cumsum(starts)[:-1])]
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes, null for an empty set), sketch of every row."""

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column("text").to_pylist())
            yield {
                "doc_id": b.column("doc_id"), "n_shingles": [len(s) for s in sets],
                "set_key": [_set_key(s) for s in sets], "sketch": [s[:SKETCH].astype("<u8").tobytes() for s in sets],
            }

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run,
                       "doc_id long, n_shingles long, set_key binary, sketch binary")


def _set_key(values: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(values.astype("<u8").tobytes()) if len(values) else None


def _values(classes: DataFrame) -> DataFrame:
    """One row per class and retained value."""

    def run(batches):
        for b in batches:
            sketch = [np.frombuffer(x, "<u8") for x in b.column("sketch").to_pylist()]
            sizes = [len(x) for x in sketch]
            node = np.repeat(np.array(b.column("node").to_pylist(), np.int64), sizes)
            n = np.repeat(np.array(b.column("n_shingles").to_pylist(), np.int64), sizes)
            yield {"node": node, "n_shingles": n, "value": np.concatenate(sketch or [np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64),
                   "size": np.repeat(np.array(sizes, np.int64), sizes)}

    return map_batches(classes.select("node", "sketch", "n_shingles"), run, "node long, n_shingles long, value long, size long")


def _needed(size):
    """Values a sketch of this size must share with others to have any link."""
    return F.least(F.ceil(size * PERCENT / 100), F.when(size * 100 < SKETCH * PERCENT, size).otherwise(F.lit(SHARED)))


def _keys(classes: DataFrame) -> DataFrame:
    """node, n_shingles, key, shared: the inverted lists."""
    values = _values(classes)
    common = values.groupBy("value").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    mine = (join_apart(values, common.select("value"), ["value"]).groupBy("node", "n_shingles", "size")
            .agg(F.sort_array(F.collect_list("value")).alias("values"))  # at most SKETCH of them
            .where(F.size("values") >= _needed(F.col("size"))))
    # Hash order is that of unsigned integers.
    ordered = F.concat(F.filter("values", lambda v: v >= 0), F.filter("values", lambda v: v < 0))
    return mine.select("node", "n_shingles", F.size("values").alias("shared"), F.explode(F.slice(ordered, 1, KEYS)).alias("key"))


def _may_link(pairs: DataFrame) -> DataFrame:
    """Keep pairs whose union sketch allows the similarity; rows a, b, sketch_a, sketch_b."""

    def run(batches):
        for b in batches:
            left = [np.frombuffer(x, "<u8") for x in b.column("sketch_a").to_pylist()]
            right = [np.frombuffer(x, "<u8") for x in b.column("sketch_b").to_pylist()]
            keep = [sketches_allow(x, y) for x, y in zip(left, right)]
            yield {n: [v for v, k in zip(b.column(n).to_pylist(), keep) if k] for n in ("a", "b")}

    return map_batches(pairs.select("a", "b", "sketch_a", "sketch_b"), run, "a long, b long")


def sketches_allow(a: np.ndarray, b: np.ndarray) -> bool:
    """Estimate from the smallest values of the union; whole sets are judged exactly."""
    union = np.union1d(a, b)
    both = np.intersect1d(a, b, assume_unique=True)
    if len(a) < SKETCH and len(b) < SKETCH:
        return 100 * len(both) >= PERCENT * len(union)
    union = union[:SKETCH]
    return int((both <= union[-1]).sum()) >= SHARED * len(union) / SKETCH


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles (binary): full sets of the documents that stand for classes."""

    def run(batches):
        for b in batches:
            yield {"node": b.column("node"),
                   "shingles": [s.astype("<u8").tobytes() for s in shingle_sets(b.column("text").to_pylist())]}

    some = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes.distinct(), "node")
    return map_batches(some.groupBy("node").agg(F.first("text").alias("text")), run, "node long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            left, right = b.column("left").to_pylist(), b.column("right").to_pylist()
            keep = [linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(left, right)]
            yield {n: [v for v, k in zip(b.column(n).to_pylist(), keep) if k] for n in ("a", "b")}

    both = (pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a"))
    return map_batches(both.select("a", "b", "left", "right"), run, "a long, b long")


def joining_links(side: np.ndarray, node: np.ndarray, component: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between classes of side 0 and all given ones that join different components, found by full sets."""
    if len(set(component.tolist())) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    near = np.flatnonzero(side == 0)
    both = np.zeros((len(near), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n_columns = int(column[-1]) + 1 if len(column) else 0
    width = min(n_columns, max(1, (1 << 22) // len(sets)))
    for at in range(0, n_columns, max(1, width)):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        both += part[near] @ part.T
    union = sizes[near][:, None] + sizes[None, :] - both
    hit = (100 * both >= PERCENT * union) & (component[near][:, None] != component[None, :])
    root = {c: c for c in component.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(hit)):
        x, y = find(int(component[near[i]])), find(int(component[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(node[near[i]]), int(node[j])))
    return out


def _links_in_blocks(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links inside lists (key, node, n_shingles, component, home: the leader's component) that join components.

    A list of two has nothing left to compare, and of lists with equal members one is enough.
    """
    away = F.col("component") != F.col("home")
    counts = lists.groupBy("key").agg(
        F.sum(F.when(away, 1).otherwise(0)).alias("n_away"), F.sum(F.when(away, 0).otherwise(1)).alias("n_home"),
        F.sum(F.when(away, F.col("n_shingles")).otherwise(0)).alias("values_away"),
        F.sum(F.when(away, 0).otherwise(F.col("n_shingles"))).alias("values_home"),
        F.bit_xor(F.xxhash64("node")).alias("members"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("members_too"))
    chosen = (counts.where("n_away > 0 AND n_away + n_home > 2")
              .groupBy("members", "members_too", *(sizes := ["n_away", "n_home", "values_away", "values_home"]))
              .agg(F.min("key").alias("key")))
    placed = join_apart(lists, chosen.select("key", *sizes), ["key"]).select("key", "node", "component", away.alias("away"), *(
        F.ceil(F.greatest(F.col(f"n_{x}") / BLOCK, F.col(f"values_{x}") / BLOCK_VALUES)).cast("int").alias(f"blocks_{x}")
        for x in ("away", "home")))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("away"), F.col("blocks_away")).otherwise(F.col("blocks_home"))).cast("int")
    # Block i of those away meets block j of those away (i <= j) and every block of the others.
    meets = F.when(
        F.col("away"),
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("blocks_away") - 1), lambda o: F.struct(
                F.lit(0).alias("kind"), F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j"),
                F.when(o >= F.col("mine"), 0).otherwise(1).alias("side"))),
            F.transform(F.filter(F.sequence(F.lit(-1), F.col("blocks_home") - 1), lambda o: o >= 0), lambda o: F.struct(
                F.lit(1).alias("kind"), F.col("mine").alias("i"), o.alias("j"), F.lit(0).alias("side")))),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks_away") - 1), lambda o: F.struct(
        F.lit(1).alias("kind"), o.alias("i"), F.col("mine").alias("j"), F.lit(1).alias("side"))))
    tasks = placed.withColumn("mine", mine).select("key", "node", "component", F.explode(meets).alias("meet"))
    rows = tasks.select("key", "meet.kind", "meet.i", "meet.j", "meet.side", "node", "component").join(sets, "node")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        links = joining_links(pdf["side"].to_numpy(), pdf["node"].to_numpy(), pdf["component"].to_numpy(),
                              [np.frombuffer(x, "<u8") for x in pdf["shingles"]])
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return rows.groupBy("key", "kind", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    component_id is the smallest doc_id reachable over links, kept says
    whether that is the row's own. A text without words (or null) has the empty
    set and no link; a null doc_id keeps its row (kept) and links to nothing.
    Repeated rows get equal rows; rows that share a doc_id are one document, so
    they may both be kept. Other columns are ignored, whatever their names; an
    empty table gives an empty table.
    """
    rows = stage(sketches(docs), "sketches")
    classes = (rows.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
               .groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"),
                                     F.first("n_shingles").alias("n_shingles")))
    classes = stage(classes, "classes")
    lists = stage(_keys(classes), "lists")
    leaders = lists.groupBy("key").agg(
        F.max(F.struct("shared", (-F.col("node")).alias("minus"))).alias("top"), F.count("*").alias("n")
    ).where("n > 1").select("key", (-F.col("top.minus")).alias("leader"))
    led = join_apart(lists, leaders, ["key"])
    pairs = (led.where("leader <> node").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
             .distinct())
    short = classes.select("node", "sketch").dropDuplicates(["node"])
    pairs = (pairs.join(short.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b")), "b")
             .join(short.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), "a"))
    maybe = stage(_may_link(pairs), "pairs")
    in_lists = led.select("node").distinct()
    sets = stage(_sets_of(docs, in_lists), "sets")
    first = stage(_confirmed(maybe, sets), "links")
    known = components(first)

    def at_home(df, name, out):
        return df.join(known.select(F.col("node").alias(name), F.col("component").alias(out)), name, "left").withColumn(
            out, F.coalesce(out, name))

    open_lists = at_home(at_home(led.select("key", "node", "n_shingles", "leader"), "node", "component"), "leader", "home")
    more = stage(_links_in_blocks(open_lists, sets), "links")
    final = known if more.isEmpty() else components(first.unionByName(more))
    by_class = classes.select("set_key", "node").join(final, "node", "left").select(
        "set_key", F.coalesce("component", "node").alias("component"))
    own = rows.select("doc_id", "n_shingles", "set_key").join(by_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * both_n >= 85 * (x.n + y.n - both_n)),
reach AS (
  SELECT doc_id, doc_id AS c FROM words
  UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.doc_id)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""
