"""Read and write the nine shop tables as Parquet datasets.

A table lives at ``<root>/<name>``. Writes never overwrite the dataset being
read: each write goes to a new version folder ``<root>/<name>/v=<n>`` and
readers take the highest version, so a job that reads a table and writes its
next state stays correct and restartable (an interrupted write leaves only an
unreferenced folder without a ``_SUCCESS`` marker).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overhaul.schema import SCHEMAS

_VERSION = re.compile(r"^v=(\d+)$")


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto the table's schema: column order, names and types.

    Casting to decimal(10,2) rounds half away from zero; a value that does not
    fit raises under ANSI mode, as a numeric(10,2) column would.
    """
    schema = SCHEMAS[table]
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _hadoop_fs(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for status in fs.listStatus(p):
        m = _VERSION.match(status.getPath().getName())
        if m and fs.exists(status.getPath().suffix("/_SUCCESS")):
            out.append(int(m.group(1)))
    return sorted(out)


def table_path(spark: SparkSession, root: str, name: str, version: int | None = None) -> str:
    """Path of a table version: the given one, else the latest written one,
    else the plain dataset path."""
    base = f"{root.rstrip('/')}/{name}"
    if version is not None:
        return f"{base}/v={version}"
    versions = _versions(spark, base)
    if versions:
        return f"{base}/v={versions[-1]}"
    return base


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """Scan one table with its declared schema (never inferred)."""
    return spark.read.schema(SCHEMAS[name]).parquet(table_path(spark, root, name, version))


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, root, name) for name in SCHEMAS}


def write_table(df: DataFrame, root: str, name: str, sort_within: list[str] | None = None,
                version: int | None = None) -> str:
    """Write the next version of a table (or the given one) and return its path.

    Writing a given version overwrites it, which makes a re-run of the same
    step idempotent.

    ``sort_within`` clusters rows inside each file (e.g. by date) so Parquet
    min/max statistics let date filters skip row groups.
    """
    spark = df.sparkSession
    base = f"{root.rstrip('/')}/{name}"
    if version is None:
        versions = _versions(spark, base)
        version = (versions[-1] + 1) if versions else 1
    path = f"{base}/v={version}"
    out = conform(df, name)
    if sort_within:
        out = out.sortWithinPartitions(*sort_within)
    out.write.mode("overwrite").parquet(path)
    return path



def export_json(df: DataFrame, path: str) -> str:
    """Deliver a result as JSON records (one object per row, column name ->
    value), the shape the service returned; written in parallel, one file
    per partition."""
    df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)
    return path


# Column each table's files are range-clustered by: the date for tables
# selected by days, the order key for order lines (so the id range of the
# selected orders skips whole files), the key for the catalogues.
CLUSTER_BY = {
    "orders": "order_date",
    "purchases": "purchase_date",
    "order_services": "order_id",
    "order_materials": "order_id",
    "order_staffers": "order_id",
    "services": "service_id",
    "materials": "material_id",
    "staffers": "staffer_id",
    "discount_cards": "card_number",
}


def save_tables(tables: dict[str, DataFrame], root: str, files: int | None = None) -> dict[str, str]:
    """Write all tables as new versions, each range-partitioned and sorted by
    its ``CLUSTER_BY`` column, so every file covers a narrow range of it and
    Parquet min/max statistics let pushed filters skip files and row groups.
    ``files`` is the number of files per table (default: the shuffle
    partition count, coalesced by AQE)."""
    out = {}
    for name, df in tables.items():
        col = CLUSTER_BY[name]
        ranged = df.repartitionByRange(files, col) if files else df.repartitionByRange(col)
        out[name] = write_table(ranged, root, name, sort_within=[col])
    return out
