"""Snapshots of the shop tables, changed part by part and all or nothing.

A store is a folder with data files and manifests. Every table is cut into
parts: by the month of its date (order lines: of their order's date; tables
without one: month 0) and by a hash of its key into ``buckets``. All order
tables share one cut, so an order's header and lines lie in parts of one name.

* A *manifest* names, for every table and part, the sets of files that hold it,
  and for every table the largest id ever given. It is the snapshot: readers
  take the newest one and see the state of all tables that it names.
* A *commit* writes the new content of the touched parts into sets of its own,
  then the next manifest, which carries all other parts over by reference. The
  manifest is renamed into place and the rename refuses to replace a file (on
  HDFS atomically; a store for several writers on an object storage needs one
  with conditional writes), so of two writers from one snapshot the second gets
  ``Conflict`` and nothing of it is seen; it starts again from the new snapshot.
  A job that dies before the rename leaves only files that no manifest names.
* *Ids* are given from the table's mark on and the mark is raised in the same
  manifest, so the id of a deleted row never comes back and no table is read to
  find the largest one.

The driver handles part names only: at most months times buckets, whatever the
number of rows.
"""

from __future__ import annotations

import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overhaul.schema import CHILD_TABLES, KEYS, SCHEMAS
from overhaul.sources.tables import conform

# The date that a table is cut by, and the column whose hash is the bucket.
DATES = {"orders": "order_date", "purchases": "purchase_date"}
ORDER_TABLES = ("orders", *CHILD_TABLES)
CUT_BY = {**KEYS, **{name: "order_id" for name in CHILD_TABLES}}
PART = ["month", "bucket"]
# Tables with surrogate ids, whose largest given id is kept.
MARKED = [name for name, key in KEYS.items() if SCHEMAS[name][key].dataType == T.LongType()]

# Sums of each part's movements by material, renewed with the part (see reports.materials_using).
SUMS = {"purchase_sums": "purchases", "material_sums": "order_materials"}
SUMS_SCHEMA = T.StructType([
    T.StructField("material_id", T.LongType()), T.StructField("quantity", T.DecimalType(38, 2)), T.StructField("n", T.LongType())])
ALL_SCHEMAS = {**SCHEMAS, **{name: SUMS_SCHEMA for name in SUMS}}

WRITERS = 4  # tables that a commit writes at the same time
SPREAD_ROWS = 4_000_000  # a new store's order lines beyond this are written where the join with their orders leaves them

_MANIFEST = re.compile(r"^(\d+)\.json$")


class Conflict(Exception):
    """Another writer has committed from the same snapshot."""


@dataclass
class Snapshot:
    root: str
    version: int
    buckets: int
    sets: dict[str, dict[str, list[str]]]  # table -> part -> the sets of files that hold it
    marks: dict[str, int] = field(default_factory=dict)
    replaced: dict[str, dict[str, list[str]]] = field(default_factory=dict)  # table -> set -> its parts that hold no more

    def parts(self, name: str) -> list[str]:
        return list(self.sets.get(name, {}))


def month_of(date) -> F.Column:
    """199901 for a date in January 1999, 0 for none."""
    return F.coalesce(F.year(date) * 100 + F.month(date), F.lit(0)).cast("int")


def bucket_of(key, buckets: int) -> F.Column:
    return F.pmod(F.hash(key), F.lit(buckets)).cast("int")


def part_name(month: int, bucket: int) -> str:
    return f"month={month}/bucket={bucket}"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _listed(spark: SparkSession, path: str) -> list[str]:
    fs, p = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _manifest(root: str, version: int) -> str:
    return f"{root}/manifests/{version}.json"


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The newest snapshot of a store, or an earlier one."""
    root = root.rstrip("/")
    if version is None:
        version = max((int(m[1]) for f in _listed(spark, f"{root}/manifests") if (m := _MANIFEST.match(f))), default=0)
        if not version:
            raise FileNotFoundError(f"no snapshot in {root}")
    fs, p = _files(spark, _manifest(root, version))
    stream = fs.open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Snapshot(root=root, version=version, **json.loads(text))


def _publish(spark: SparkSession, snap: Snapshot) -> None:
    """Write the manifest under a name of its own, then rename it into place unless that place is taken."""
    text = json.dumps({"buckets": snap.buckets, "sets": snap.sets, "marks": snap.marks, "replaced": snap.replaced}, sort_keys=True)
    jvm = spark._jvm
    fs, draft = _files(spark, f"{snap.root}/drafts/{uuid.uuid4().hex}.json")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    _, final = _files(spark, _manifest(snap.root, snap.version))
    fs.mkdirs(final.getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), no_options)
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"snapshot {snap.version} of {snap.root} was written by another job") from error
        raise


def read(spark: SparkSession, snap: Snapshot, name: str, parts=None, cut: bool = False) -> DataFrame:
    """A table of a snapshot; of its ``parts`` only, if given. ``cut`` keeps the columns month and bucket, which
    filters on them use to leave out files."""
    schema = ALL_SCHEMAS[name]
    base = f"{snap.root}/data/{name}"
    by_set: dict[str, list[str]] = {}
    for part, tokens in snap.sets.get(name, {}).items():
        if parts is None or part in parts:
            for token in tokens:
                by_set.setdefault(token, []).append(part)
    paths, left_out = [], F.lit(False)
    for token, held in by_set.items():
        old = snap.replaced.get(name, {}).get(token, [])
        if parts is None and len(old) <= len(held):  # one folder for the whole set, without its replaced parts
            paths.append(f"{base}/set={token}")
            if old:
                of_part = F.concat(F.lit("month="), F.col("month"), F.lit("/bucket="), F.col("bucket"))
                left_out = left_out | ((F.col("set") == token) & of_part.isin(old))
        else:
            paths += [f"{base}/set={token}/{p}" for p in held]
    stored = T.StructType([*(T.StructField(f.name, f.dataType) for f in schema), T.StructField("set", T.StringType()),
                           *(T.StructField(c, T.IntegerType()) for c in PART)])
    if paths:
        df = spark.read.schema(stored).option("basePath", base).parquet(*paths).where(~left_out)
    else:
        df = spark.createDataFrame([], stored)
    return df.select(*schema.names, *(PART if cut else []))


def read_all(spark: SparkSession, snap: Snapshot, cut: bool = False) -> dict[str, DataFrame]:
    """All tables of a snapshot, and the movement sums of its parts."""
    return {name: read(spark, snap, name, cut=cut or name in SUMS) for name in ALL_SCHEMAS}


def with_parts(tables: dict[str, DataFrame], buckets: int) -> dict[str, DataFrame]:
    """The tables with month and bucket. Order lines take their month from ``tables["orders"]``.

    Orders grow with their lines: they are never sent whole to every task.
    """
    out = {}
    for name, df in tables.items():
        bucket = bucket_of(CUT_BY[name], buckets)
        if name in CHILD_TABLES:
            dated = tables["orders"].select("order_id", month_of("order_date").alias("month")).hint("merge")
            out[name] = df.join(dated, "order_id", "left").withColumns({"month": F.coalesce("month", F.lit(0)), "bucket": bucket})
        else:
            out[name] = df.withColumns({"month": month_of(DATES[name]) if name in DATES else F.lit(0), "bucket": bucket})
    return out


def _laid_out(spark: SparkSession, name: str, df: DataFrame, gather: bool = True) -> DataFrame:
    """Rows (with month and bucket) as the tasks write them.

    Gathered by part, a part that holds very many rows is cut by Spark into several tasks and files, and small parts
    are put together. Else rows stay in the tasks that they are in, each of which writes a file for every part that
    it has rows of: order lines are not shuffled a second time after the join with their orders.
    """
    names = ALL_SCHEMAS[name].names
    if name in SCHEMAS:
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields]
        df = df.select(*typed, *PART)
    df = df.select(*names, *PART)
    if gather:
        df = spark.sql("SELECT /*+ REBALANCE(month, bucket) */ * FROM {rows}", rows=df)
    return df.sortWithinPartitions(*PART, names[0])


def _write(spark: SparkSession, snap: Snapshot, name: str, df: DataFrame, gather: bool = True) -> tuple[str, list[str]]:
    """Write rows (with month and bucket) as a new set; returns its name and parts."""
    token = uuid.uuid4().hex
    path = f"{snap.root}/data/{name}/set={token}"
    _laid_out(spark, name, df, gather).write.partitionBy(*PART).parquet(path)
    parts = [f"{m}/{b}" for m in _listed(spark, path) if m.startswith("month=")
             for b in _listed(spark, f"{path}/{m}") if b.startswith("bucket=")]
    return token, parts


def commit(spark: SparkSession, snap: Snapshot, rows: dict[str, DataFrame], replaced: dict[str, list[str]],
           marks: dict[str, int] | None = None, spread: frozenset[str] = frozenset()) -> Snapshot:
    """The next snapshot: in each table of ``rows`` the ``replaced`` parts hold what ``rows`` (with month and
    bucket) has for them and nothing else, other parts get the rows added; all else is carried over.

    The rows of the tables in ``spread`` and their sums are not gathered by part.
    Movement sums follow their tables: of the written rows only. Raises ``Conflict`` if the snapshot after
    ``snap`` exists by then; nothing is changed in that case, nor by a failure at any earlier point.
    """
    sets = {name: dict(parts) for name, parts in snap.sets.items()}
    old = {name: {token: list(parts) for token, parts in tokens.items()} for name, tokens in snap.replaced.items()}
    gather = lambda name: SUMS.get(name, name) not in spread

    def put(tables, gone):
        for name, (token, parts) in tables.items():
            held = sets.setdefault(name, {})
            for part in gone.get(name, []):
                for before in held.pop(part, []):
                    old.setdefault(name, {}).setdefault(before, []).append(part)
            for part in parts:
                held[part] = [*held.get(part, []), token]

    with ThreadPoolExecutor(WRITERS) as pool:
        write = lambda tables: dict(zip(tables, pool.map(lambda n: _write(spark, snap, n, tables[n], gather(n)), tables)))
        written = write(rows)
        put(written, replaced)
        moved = {}
        for sums, source in SUMS.items():
            if source in written:
                token, parts = written[source]
                new = Snapshot(snap.root, 0, snap.buckets, {source: {p: [token] for p in parts}})
                moved[sums] = read(spark, new, source, cut=True).groupBy("material_id", *PART).agg(
                    F.sum("quantity").cast("decimal(38,2)").alias("quantity"), F.count("*").alias("n"))
        put(write(moved), {sums: replaced.get(source, []) for sums, source in SUMS.items()})
    after = Snapshot(snap.root, snap.version + 1, snap.buckets, sets, {**snap.marks, **(marks or {})}, old)
    _publish(spark, after)
    return after


def create(spark: SparkSession, root: str, tables: dict[str, DataFrame], buckets: int) -> Snapshot:
    """A new store with the given tables (all, or those a job needs) as its first snapshot; ids go on from the
    largest key of each table."""
    empty = Snapshot(root.rstrip("/"), 0, buckets, {})
    largest = {name: tables[name].agg(F.max(KEYS[name])).first()[0] or 0 for name in MARKED if name in tables}
    spread = frozenset(name for name in CHILD_TABLES if name in tables and tables[name].count() > SPREAD_ROWS)
    conformed = {name: conform(df, name) for name, df in tables.items()}
    return commit(spark, empty, with_parts(conformed, buckets), {}, largest, spread)
