"""Change-set jobs: the write endpoints of the original service, in bulk.

The service saved one object per request, each statement committed on its
own. Here a job takes a DataFrame of requests (with a ``seq`` column giving
their arrival order) and returns the next state of the affected tables; the
caller writes it as a new table version (``overhaul.sources.write_table``),
so the job can be re-run after a failure without partial effects.

Semantics kept from the service:

* save: key NULL or 0 inserts with a new id (``serial``); any other key
  updates the row *if it exists* (an unknown key is a no-op);
* several requests for one key: the last one (highest ``seq``) wins, of equal
  ``seq`` the one with the largest values, so a re-run decides alike;
* insert with a caller-supplied key: an existing or NULL key is rejected;
* delete of an order cascades to its lines; delete of a referenced
  material/service/staffer is refused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overhaul.schema import CHILD_TABLES, KEYS, REFERENCES, SCHEMAS, not_null_columns
from overhaul.functions.joins import split_join
from overhaul.functions.ranking import row_numbers
from overhaul.session import materialize

Tables = dict[str, DataFrame]


def _is_new(key: str):
    return F.col(key).isNull() | (F.col(key) == 0)


def latest(changes: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The last request per key (max ``seq``, then the largest values), one row per key.

    The maximum is aggregated partially on the map side, so a key that holds
    a large share of the requests never gathers them in one task.
    """
    values = [c for c in changes.columns if c not in (key, seq)]
    packed = F.struct(F.col(seq), *[F.col(c) for c in values])
    return (changes.groupBy(key)
            .agg(F.max(packed).alias("_last"))
            .select(key, *[F.col(f"_last.{c}").alias(c) for c in values], F.col(f"_last.{seq}").alias(seq)))


def assign_ids(rows: DataFrame, id_col: str, start: int, seq: str = "seq") -> DataFrame:
    """Give ``rows`` dense new ids start+1, start+2, ... in ``seq`` order,
    without a global window (``functions.ranking.row_numbers``)."""
    numbered = row_numbers(rows, [seq], "_row")
    return numbered.withColumn(id_col, F.lit(int(start)) + F.col("_row") + 1).drop("_row")


def max_key(table: DataFrame, key: str) -> int:
    """Current largest key (0 for an empty table): one scalar to the driver."""
    return table.agg(F.max(key)).first()[0] or 0


def apply_updates(table: DataFrame, changes: DataFrame, key: str, seq: str = "seq",
                  columns: list[str] | None = None) -> DataFrame:
    """UPDATE ... SET columns WHERE key = ?: the last request per key replaces
    the written ``columns`` (default: every value column) of an existing row;
    unknown keys are ignored."""
    values = [c for c in table.columns if c != key]
    written = [c for c in (columns or values) if c != key]
    upd = latest(changes.select(key, *written, seq), key, seq).drop(seq)
    upd = upd.select(key, *[F.col(c).alias(f"_u_{c}") for c in written], F.lit(True).alias("_hit"))
    joined = table.join(upd, key, "left")
    return joined.select(key, *[
        (F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)) if c in written else F.col(c)).alias(c)
        for c in values
    ]).select(*table.columns)


def apply_saves(table: DataFrame, changes: DataFrame, key: str, seq: str = "seq",
                start: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Save requests (insert when the key is NULL/0, else update if present).

    ``columns`` are the columns a request writes (default: all); the others
    keep their value on update and are NULL on insert. New rows get ids after
    ``start`` (default: the current largest key) in request order.
    """
    cols = table.columns
    written = [c for c in (columns or cols) if c != key]
    updates = changes.where(~_is_new(key))
    inserts = changes.where(_is_new(key))
    updated = apply_updates(table, updates, key, seq, written)
    base = max_key(table, key) if start is None else start
    fresh = inserts.select(*written, seq)
    for c in cols:
        if c != key and c not in written:
            fresh = fresh.withColumn(c, F.lit(None).cast(table.schema[c].dataType))
    inserted = assign_ids(fresh, key, base, seq).select(*cols)
    return updated.unionByName(inserted)


# A purchase request carries a sum, but the service never stores it.
PURCHASE_WRITTEN = ["purchase_date", "trader", "material_id", "price", "quantity"]


def save_purchases(purchases: DataFrame, changes: DataFrame, seq: str = "seq") -> DataFrame:
    """Save purchase requests; the stored ``sum`` is left as it is (NULL for
    new purchases) whatever the request says."""
    return apply_saves(purchases, changes, "purchase_id", seq, columns=PURCHASE_WRITTEN)


def apply_inserts(table: DataFrame, changes: DataFrame, key: str, seq: str = "seq"):
    """INSERT with caller-supplied keys. Returns (new_table, rejected).

    A NULL key, a key already in the table, or one already inserted by an
    earlier request of the batch (of equal ``seq``, by the one with the smallest
    values) is rejected, as the original's primary key does. Every request is
    either in the new table or among the rejected, equal requests one by one.
    """
    cols = table.columns
    values = [c for c in cols if c != key]
    request = F.struct(F.col(seq), *[F.col(c) for c in values])
    first = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(request).alias("_first"))
    accepted = first.join(table.select(key), key, "left_anti")
    counted = changes.groupBy(*cols, seq).agg(F.count("*").cast("int").alias("_n"))
    lost = (split_join(counted, accepted, [key], "left")
            .withColumn("_n", F.col("_n") - F.when(request.eqNullSafe(F.col("_first")), 1).otherwise(0))
            .where("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), "_n"))))
    inserted = accepted.select(key, *[F.col(f"_first.{c}").alias(c) for c in values])
    return table.unionByName(inserted.select(*cols)), lost.select(*cols, seq)


def apply_deletes(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """DELETE ... WHERE key IN keys (the key set de-duplicated first)."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def referenced_keys(key: str, children: list[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct key values used by child tables (pre-aggregated per child, so
    a heavily used key is collapsed map-side before any join)."""
    used = [c.select(F.col(col).alias(key)) for c, col in children]
    return reduce(DataFrame.unionByName, used).distinct()


def delete_restricted(table: DataFrame, keys: DataFrame, key: str,
                      children: list[tuple[DataFrame, str]]):
    """DELETE with ON DELETE RESTRICT references. Returns (new_table, rejected
    keys). A key still referenced by any child row is refused and kept."""
    req = keys.select(key).distinct()
    used = referenced_keys(key, children)
    rejected = req.join(used, key, "left_semi")
    deletable = req.join(used, key, "left_anti")
    return table.join(deletable, key, "left_anti"), rejected


def delete_orders(t: Tables, keys: DataFrame) -> Tables:
    """DELETE orders; their service, material and staff lines go too (CASCADE)."""
    ids = keys.select("order_id").distinct()
    out = dict(t)
    for name in ("orders", *CHILD_TABLES):
        out[name] = split_join(t[name], ids, ["order_id"], "left_anti")
    return out


def delete_rows(t: Tables, name: str, keys: DataFrame):
    """Delete from the table ``name`` by its key, as the references say.

    Restricting children refuse the key, cascading ones lose their rows.
    Returns (tables, rejected keys).
    """
    key = KEYS[name]
    children = [r for r in REFERENCES if r.parent == name]
    restricting = [(t[r.child], r.column) for r in children if r.on_delete == "restrict"]
    requested = keys.select(key).where(F.col(key).isNotNull()).distinct()
    rejected = requested.limit(0)
    if restricting:
        used = referenced_keys(key, restricting)
        rejected, requested = requested.join(used, key, "left_semi"), requested.join(used, key, "left_anti")
    out = dict(t)
    out[name] = split_join(t[name], requested, [key], "left_anti")
    for r in children:
        if r.on_delete == "cascade":
            gone = requested.withColumnRenamed(key, r.column)
            out[r.child] = split_join(t[r.child], gone, [r.column], "left_anti")
    return out, rejected


def _order_lines(docs: DataFrame, table: str, keep: list[str]) -> DataFrame:
    """The child rows of order documents, with the documents' columns ``keep``."""
    cols = [f.name for f in SCHEMAS[table].fields if f.name != "order_id"]
    lines = docs.select(*keep, F.explode(table).alias("_it"))
    return lines.select(*keep, *[F.col(f"_it.{c}").alias(c) for c in cols])


def faulty_documents(t: Tables, docs: DataFrame) -> DataFrame:
    """Distinct ``_doc`` of documents that break a NOT NULL rule or refer to an
    unknown service, material or staffer."""
    required = [c for c in not_null_columns("orders") if c != "order_id"]
    bad = docs.where(reduce(lambda x, y: x | y, [F.col(c).isNull() for c in required])).select("_doc")
    for r in REFERENCES:
        if r.child in CHILD_TABLES and r.parent != "orders":
            lines = _order_lines(docs, r.child, ["_doc"])
            nulls = [F.col(c).isNull() for c in not_null_columns(r.child) if c != "order_id"]
            parents = t[r.parent].select(F.col(KEYS[r.parent]).alias(r.column), F.lit(True).alias("_known"))
            joined = split_join(lines, parents, [r.column], "left")
            bad = bad.unionByName(joined.where(reduce(lambda x, y: x | y, nulls, F.col("_known").isNull())).select("_doc"))
    return bad.distinct()


def _passed(t: Tables, docs: DataFrame, seq: str):
    """Of numbered documents without faults: those for new orders, and those for orders that exist."""
    small = docs.select("_doc", "order_id", seq).join(faulty_documents(t, docs), "_doc", "left_anti")
    known = small.where(~_is_new("order_id")).join(t["orders"].select("order_id"), "order_id", "left_semi")
    return small.where(_is_new("order_id")).select("_doc", seq), known


def rejected_orders(t: Tables, docs: DataFrame, seq: str = "seq") -> DataFrame:
    """The documents that ``save_orders`` rejects, without working out what it saves."""
    docs = materialize(docs.withColumn("_doc", F.monotonically_increasing_id()), "order-requests")
    new, known = _passed(t, docs, seq)
    return docs.join(new.select("_doc").unionByName(known.select("_doc")), "_doc", "left_anti").drop("_doc")


def save_orders(t: Tables, docs: DataFrame, seq: str = "seq", start: int | None = None):
    """Save whole order documents. Returns (tables, rejected documents).

    A document with order_id NULL/0 becomes a new order (new id in request
    order); otherwise it replaces the header of the existing order and *all*
    its lines, even with empty lists. The child rows take the order id of
    their header. Several documents for one order: the last one wins. A
    document is rejected whole if its order is unknown, a required column is
    NULL, or a line refers to an unknown service, material or staffer (the
    database refuses each of these); the last one that is left wins.
    """
    header_cols = [f.name for f in SCHEMAS["orders"].fields]
    orders = t["orders"]
    # A fixed snapshot of the request batch, then a small frame of what becomes
    # of each document; the four tables are all driven by these two.
    docs = materialize(docs.withColumn("_doc", F.monotonically_increasing_id()), "order-requests")
    new, known = _passed(t, docs, seq)
    created = assign_ids(new, "new_id", max_key(orders, "order_id") if start is None else start, seq)
    last = known.groupBy("order_id").agg(F.max(F.struct(F.col(seq), "_doc")).alias("_last"))
    fates = materialize(
        created.select("_doc", F.col("new_id").alias("saved_id"), F.lit(False).alias("replaces"))
        .unionByName(last.select(F.col("_last._doc").alias("_doc"), F.col("order_id").alias("saved_id"),
                                 F.lit(True).alias("replaces"))), "order-fates")
    passed = known.select("_doc").unionByName(created.select("_doc"))
    rejected = docs.join(passed, "_doc", "left_anti").drop("_doc")
    saved = docs.drop("order_id").join(fates.select("_doc", F.col("saved_id").alias("order_id")), "_doc")
    replaced = fates.where("replaces").select(F.col("saved_id").alias("order_id"))

    out = dict(t)
    out["orders"] = orders.join(replaced, "order_id", "left_anti").unionByName(saved.select(*header_cols))
    for table in CHILD_TABLES:
        cols = [f.name for f in SCHEMAS[table].fields]
        kept = t[table].join(replaced, "order_id", "left_anti")
        out[table] = kept.unionByName(_order_lines(saved, table, ["order_id"]).select(*cols))
    return out, rejected


def order_tables_long(t: Tables) -> DataFrame:
    """The four order tables as one long frame (for checks and digests)."""
    cols = {
        "orders": ["order_id", "null:int order_line", "null:bigint item_id", "order_date", "car",
                   "card_number", "percent_off", "null:decimal(10,2) price", "null:decimal(10,2) quantity",
                   "null:int ktu"],
        "order_services": ["order_id", "order_line", "service_id item_id", "null:timestamp_ntz order_date",
                           "null:string car", "null:string card_number", "null:int percent_off", "price",
                           "quantity", "null:int ktu"],
        "order_materials": ["order_id", "order_line", "material_id item_id", "null:timestamp_ntz order_date",
                            "null:string car", "null:string card_number", "null:int percent_off",
                            "null:decimal(10,2) price", "quantity", "null:int ktu"],
        "order_staffers": ["order_id", "order_line", "staffer_id item_id", "null:timestamp_ntz order_date",
                           "null:string car", "null:string card_number", "null:int percent_off",
                           "null:decimal(10,2) price", "null:decimal(10,2) quantity", "ktu"],
    }

    def expr(spec):
        if spec.startswith("null:"):
            typ, name = spec[5:].split(" ")
            return f"cast(null as {typ}) as {name}"
        return spec.replace(" ", " as ") if " " in spec else spec

    parts = [t[name].selectExpr(f"'{name}' as tbl", *[expr(c) for c in specs]) for name, specs in cols.items()]
    return reduce(DataFrame.unionByName, parts)
