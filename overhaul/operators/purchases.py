"""Purchases of materials, listed with the material's attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overhaul.functions.filters import equals_unless, in_days, where_all
from overhaul.functions.money import line_amount

Tables = dict[str, DataFrame]

PURCHASE_VIEW_COLUMNS = ("purchase_id", "purchase_date", "trader", "material_id", "price", "quantity",
                         "sum", "material_name", "part", "measure", "article")


def _enrich(p: DataFrame, materials: DataFrame) -> DataFrame:
    # The original row is purchase.* then material.* then the computed sum;
    # repeated names keep the last value: material_id comes from the
    # material (NULL if unknown) and sum is recomputed (the stored one is
    # never written).
    m = materials.withColumnRenamed("material_id", "m_material_id")
    j = p.join(m, p["material_id"] == m["m_material_id"], "left")
    return j.select(
        "purchase_id", "purchase_date", "trader", F.col("m_material_id").alias("material_id"),
        "price", "quantity", line_amount("price", "quantity").alias("sum"),
        "material_name", "part", "measure", "article",
    )


def purchase_list(t: Tables, material_id: int = 0, begin=None, end=None) -> DataFrame:
    """Purchases, optionally of one material (0 = all) and within days
    [begin, end]; sorted by purchase date."""
    p = where_all(t["purchases"], equals_unless("material_id", material_id, 0),
                  in_days("purchase_date", begin, end))
    return _enrich(p, t["materials"]).orderBy(
        F.asc_nulls_last("purchase_date"), "purchase_id")


def purchase_lookup(t: Tables, keys: DataFrame) -> DataFrame:
    """The purchase cards of the ids in ``keys.purchase_id``."""
    p = t["purchases"].join(keys.select("purchase_id").distinct(), "purchase_id", "left_semi")
    return _enrich(p, t["materials"])
