"""Bucketed catalog layout: co-locate the tables that are joined on a key.

Every report joins order lines with their orders on ``order_id`` and
aggregates per order or per material. Written as catalog tables bucketed
(and sorted) by those keys with one bucket count, the joins and per-key
aggregations read co-partitioned buckets and plan no shuffle of the large
tables. The operators are unchanged: they take the DataFrames from
``read_catalog_tables`` instead of plain Parquet paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from overhaul.sources.tables import conform

# Bucket (and sort) column per table.
BUCKET_KEYS = {
    "orders": "order_id",
    "order_services": "order_id",
    "order_materials": "order_id",
    "order_staffers": "order_id",
    "purchases": "material_id",
    "materials": "material_id",
    "services": "service_id",
    "staffers": "staffer_id",
    "discount_cards": "card_number",
}


def save_catalog_tables(tables: dict[str, DataFrame], database: str, buckets: int,
                        location: str | None = None) -> None:
    """Write the tables as bucketed Parquet catalog tables ``database.name``.

    ``buckets`` should give buckets of a few hundred MB for the largest
    table; all tables share it so any two can be joined bucket by bucket.
    """
    spark = next(iter(tables.values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, df in tables.items():
        key = BUCKET_KEYS[name]
        writer = (conform(df, name).write.mode("overwrite").format("parquet")
                  .bucketBy(buckets, key).sortBy(key))
        if location:
            writer = writer.option("path", f"{location.rstrip('/')}/{name}")
        writer.saveAsTable(f"{database}.{name}")


def read_catalog_tables(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    return {name: spark.table(f"{database}.{name}") for name in BUCKET_KEYS}
