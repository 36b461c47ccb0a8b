"""Catalogue listings and key lookups (materials, services, staff, cards).

The original service answers one key per request; here a lookup takes a
DataFrame of keys, so any number of cards/materials/... are resolved in one
distributed join. Keys of the catalogue tables are unique by contract
(``overhaul.operators.integrity`` verifies it), so lookups never fan out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overhaul.functions.filters import by_name, equals_unless, name_contains, where_all

Tables = dict[str, DataFrame]

# The staffer password is never returned (the table here does not carry it).
STAFFER_PUBLIC = ("staffer_id", "staffer_name", "role", "login")


def material_list(t: Tables, name: str = "", part: bool | None = None, collation: str | None = None) -> DataFrame:
    """Materials whose name contains ``name`` (any case) and, if given, with
    ``part`` equal to the flag; sorted by name. ``collation`` (here and below)
    sorts and matches names as a database with that collation does."""
    m = t["materials"]
    part_pred = None if part is None else (F.col("part") == F.lit(bool(part)))
    return where_all(m, name_contains("material_name", name, collation), part_pred).orderBy(
        by_name("material_name", collation), "material_id")


def service_list(t: Tables, name: str = "", collation: str | None = None) -> DataFrame:
    return where_all(t["services"], name_contains("service_name", name, collation)).orderBy(
        by_name("service_name", collation), "service_id")


def staffer_list(t: Tables, role: str = "", collation: str | None = None) -> DataFrame:
    s = t["staffers"].select(*STAFFER_PUBLIC)
    return where_all(s, equals_unless("role", role, "")).orderBy(
        by_name("staffer_name", collation), "staffer_id")


def card_list(t: Tables) -> DataFrame:
    return t["discount_cards"].orderBy(F.asc_nulls_last("card_number"))


def lookup(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose ``key`` is among ``keys[key]`` (unknown keys
    yield nothing; repeated keys do not repeat rows).

    The key set is de-duplicated first (partially, on the map side), so a key
    repeated in a third of the requests is one row by the time it is joined.
    """
    return table.join(keys.select(key).distinct(), key, "left_semi")


def attach_service_price(lines: DataFrame, services: DataFrame) -> DataFrame:
    """Every line with the current list price of its service (NULL if the
    service is unknown)."""
    price = services.select("service_id", F.col("price").alias("service_price"))
    return lines.join(price, "service_id", "left")


def attach_card_percent(orders: DataFrame, cards: DataFrame) -> DataFrame:
    """Every order with the current discount of its card (NULL without card)."""
    pct = cards.select("card_number", F.col("percent_off").alias("card_percent_off"))
    return orders.join(pct, "card_number", "left")
