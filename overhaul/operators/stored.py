"""Change sets against a store: only touched parts are read and written (see ``sources.store``).

Each job takes the newest snapshot, finds the parts that its requests touch,
applies the change-set operators to these parts alone and commits them. Inserts
touch no part: their rows are added to the parts they belong to, as further
files. Every job returns the new snapshot and what was refused. A job that meets
``store.Conflict`` has changed nothing and can be run again.

Which parts are touched: the bucket follows from the key; the month of an order
or a purchase is looked up in the key and date columns of these buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overhaul.operators import changes, integrity
from overhaul.operators.requests import judged, rejected, valid, written_columns
from overhaul.schema import CHILD_TABLES, KEYS, REFERENCES, SCHEMAS
from overhaul.session import materialize
from overhaul.sources import store
from overhaul.sources.store import CUT_BY, DATES, ORDER_TABLES, Snapshot


def _names(rows: DataFrame) -> list[str]:
    """Part names of the distinct (month, bucket) of rows: at most as many as the store has parts."""
    return [store.part_name(r.month, r.bucket) for r in rows.select(*store.PART).distinct().collect()]


def _buckets(keys: DataFrame, key: str, snap: Snapshot) -> set[int]:
    return {r[0] for r in keys.select(store.bucket_of(key, snap.buckets)).distinct().collect()}


def _in_buckets(snap: Snapshot, name: str, buckets: set[int]) -> list[str]:
    return [p for p in snap.parts(name) if int(p.rpartition("=")[2]) in buckets]


def touched(spark: SparkSession, snap: Snapshot, name: str, keys: DataFrame) -> list[str]:
    """The parts of a table that hold rows with the given keys (a frame with the table's key column)."""
    key = CUT_BY[name]
    keys = keys.select(F.col(key).cast(SCHEMAS[name][key].dataType).alias(key)).where(F.col(key).isNotNull()).distinct()
    possible = _in_buckets(snap, name, _buckets(keys, key, snap))
    if name not in DATES:
        return possible
    return _names(store.read(spark, snap, name, possible, cut=True).join(keys, key, "left_semi"))


def _parents(spark: SparkSession, snap: Snapshot, name: str) -> dict[str, DataFrame]:
    return {r.parent: store.read(spark, snap, r.parent) for r in REFERENCES if r.child == name}


def save(spark: SparkSession, root: str, name: str, requests: DataFrame, seq: str = "seq"):
    """Save requests for a table with surrogate ids (W1). Returns (snapshot, refused requests with rule, column).

    Requests that break a rule are refused one by one, the last one left wins;
    new rows get ids after the table's mark, which the commit raises.
    """
    snap = store.snapshot(spark, root)
    key = KEYS[name]
    new = F.col(key).isNull() | (F.col(key) == 0)
    requests = materialize(requests, "requests")
    parts = touched(spark, snap, name, requests.where(~new))
    old = store.read(spark, snap, name, parts)
    checked = materialize(judged({**_parents(spark, snap, name), name: old}, name, requests), "judged")
    good = valid(checked)
    columns = written_columns(name)
    updated = changes.apply_updates(old, good.where(~new), key, seq, columns)
    added = good.where(new).select(*columns, seq)
    for c in old.columns:
        if c != key and c not in columns:
            added = added.withColumn(c, F.lit(None).cast(old.schema[c].dataType))
    inserted = changes.assign_ids(added, key, snap.marks[name], seq).select(*old.columns)
    rows = store.with_parts({name: updated.unionByName(inserted)}, snap.buckets)
    marks = {name: snap.marks[name] + added.count()}
    return store.commit(spark, snap, rows, {name: parts}, marks), rejected(checked)


def delete(spark: SparkSession, root: str, name: str, keys: DataFrame):
    """Delete rows by key (W4-W6): a key that a restricting child uses is refused, lines of deleted orders go too.

    Returns (snapshot, refused keys).
    """
    snap = store.snapshot(spark, root)
    key = KEYS[name]
    keys = materialize(keys.select(key).where(F.col(key).isNotNull()).distinct(), "keys")
    parts = touched(spark, snap, name, keys)
    names = ORDER_TABLES if name == "orders" else (name,)
    t = {n: store.read(spark, snap, n, parts) for n in names}
    restricting = {r.child: store.read(spark, snap, r.child) for r in REFERENCES if r.parent == name and r.on_delete == "restrict"}
    after, refused = changes.delete_rows({**restricting, **t}, name, keys)
    refused = materialize(refused, "refused")
    rows = _cut_like(snap, {n: after[n] for n in names})
    return store.commit(spark, snap, rows, {n: parts for n in names}), refused


def _cut_like(snap: Snapshot, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables with month and bucket, computed once: the parts of one commit come from one state."""
    return {n: materialize(df, f"next-{n}") for n, df in store.with_parts(tables, snap.buckets).items()}


def save_orders(spark: SparkSession, root: str, docs: DataFrame, seq: str = "seq"):
    """Save whole order documents (W7): header and all lines, in the parts of the known orders only.

    Returns (snapshot, rejected documents). The four order tables change in one commit or not at all.
    """
    snap = store.snapshot(spark, root)
    docs = materialize(docs, "documents")
    new = F.col("order_id").isNull() | (F.col("order_id") == 0)
    parts = touched(spark, snap, "orders", docs.where(~new))
    t = {n: store.read(spark, snap, n, parts) for n in ORDER_TABLES}
    for n in ORDER_TABLES:
        t.update({p: df for p, df in _parents(spark, snap, n).items() if p not in t})
    after, refused = changes.save_orders(t, docs, seq, start=snap.marks["orders"])
    rows = _cut_like(snap, {n: after[n] for n in ORDER_TABLES})
    top = rows["orders"].agg(F.max("order_id")).first()[0] or 0
    marks = {"orders": max(snap.marks["orders"], top)}
    return store.commit(spark, snap, rows, {n: parts for n in ORDER_TABLES}, marks), refused


def written_files(before: Snapshot, after: Snapshot) -> dict[str, list[str]]:
    """The parts of each table that a commit has written, replaced or taken out."""
    names = sorted(set(before.sets) | set(after.sets))
    return {n: sorted(p for p in set(before.parts(n)) | set(after.parts(n))
                      if before.sets.get(n, {}).get(p) != after.sets.get(n, {}).get(p)) for n in names}


def violations(spark: SparkSession, before: Snapshot, after: Snapshot) -> DataFrame:
    """The violations (W8) that a commit on a clean state has made: those of the full check on the new state.

    Read are the changed parts, the keys of the parents that they refer to (of orders those in the same buckets),
    and the other parts of a child table only where parent keys have gone, joined with these keys.
    """
    changed = {n: p for n, p in written_files(before, after).items() if p and n in SCHEMAS}
    now = {n: store.read(spark, after, n, p) for n, p in changed.items()}
    buckets = {n: {int(p.rpartition("=")[2]) for p in parts} for n, parts in changed.items()}
    found = [integrity.row_violations(df, n) for n, df in now.items()]
    for name, df in now.items():
        if name in KEYS:
            key = KEYS[name]
            near = store.read(spark, after, name, _in_buckets(after, name, buckets[name])).select(key)
            found.append(integrity.key_violations(near.join(df.select(key).distinct(), key, "left_semi"), name))
    t = {n: now.get(n, store.read(spark, after, n, [])) for n in SCHEMAS}
    for parent in dict.fromkeys(r.parent for r in REFERENCES):
        if parent in changed:
            key = KEYS[parent]
            gone = store.read(spark, before, parent, changed[parent]).select(key).join(now[parent].select(key), key, "left_anti")
            gone = materialize(gone.distinct(), "gone")
            for r in REFERENCES:
                if r.parent == parent:
                    rest = [p for p in after.parts(r.child) if p not in changed.get(r.child, [])]
                    rest = [p for p in rest if parent != "orders" or int(p.rpartition("=")[2]) in buckets[parent]]
                    left = store.read(spark, after, r.child, rest).join(gone.withColumnRenamed(key, r.column), r.column, "left_semi")
                    t[r.child] = t[r.child].unionByName(left)
                    buckets[r.child] = buckets.get(r.child, set()) | {int(p.rpartition("=")[2]) for p in rest}
    order_buckets = set().union(*(buckets.get(n, set()) for n in CHILD_TABLES))
    for parent in dict.fromkeys(r.parent for r in REFERENCES):
        parts = _in_buckets(after, parent, order_buckets) if parent == "orders" else None
        t[parent] = store.read(spark, after, parent, parts)
    found.append(integrity.reference_violations(t))
    return reduce(DataFrame.unionByName, [f for f in found if f is not None])


__all__ = ["save", "delete", "save_orders", "touched", "written_files", "violations"]
