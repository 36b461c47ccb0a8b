"""Shop tables derived from the driver's TPC-H-like test data.

Every view is a projection of a given table (no sampling, no row caps), so the
derived tables grow with the scale factor. Ids are shifted by one because 0 is
a sentinel in the shop semantics ("new row", "no filter", "subtotal row").
The same derivations appear as SQL ``WITH`` clauses in the DuckDB oracles
(``VIEW_SQL``), so both engines start from identical inputs.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overhaul.schema import MONEY

# Schemas of the source tables used (declared, so no footer is read to infer them).
SOURCE_SCHEMAS = {
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
SOURCE_TABLES = tuple(SOURCE_SCHEMAS)

# Table definitions are lazy and immutable, so one set per session and folder
# is shared by all queries (as views would be).
_DEFINED: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shop_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The nine shop tables as lazy DataFrames over ``sf_dir``."""
    per_session = _DEFINED.setdefault(spark, {})
    key = sf_dir.rstrip("/")
    if key not in per_session:
        per_session[key] = _define(spark, key)
    return dict(per_session[key])


def _define(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    src = {name: _read(spark, sf_dir, name) for name in SOURCE_TABLES}
    s, c, p, o, li, ev = (src[n] for n in SOURCE_TABLES)
    dec = lambda col: F.col(col).cast(MONEY)
    tables = {
        "staffers": s.select(
            (F.col("s_suppkey") + 1).alias("staffer_id"),
            F.col("s_name").alias("staffer_name"),
            F.when(F.col("s_suppkey") % 10 == 0, F.lit("manager")).otherwise(F.lit("mechanic")).alias("role"),
            F.concat(F.lit("user"), F.col("s_suppkey").cast("string")).alias("login"),
        ),
        "discount_cards": c.select(
            F.col("c_custkey").cast("string").alias("card_number"),
            F.col("c_name").alias("customer_name"),
            F.concat(F.lit("+"), F.lpad(F.col("c_custkey").cast("string"), 10, "0")).alias("customer_telephone"),
            (F.col("c_custkey") % 16).cast("int").alias("percent_off"),
        ),
        "services": p.select(
            (F.col("p_partkey") + 1).alias("service_id"),
            F.col("p_name").alias("service_name"),
            dec("p_retailprice").alias("price"),
        ),
        "materials": p.select(
            (F.col("p_partkey") + 1).alias("material_id"),
            F.col("p_name").alias("material_name"),
            (F.col("p_size") % 2 == 0).alias("part"),
            F.lit("pcs").alias("measure"),
            F.col("p_brand").alias("article"),
        ),
        "orders": o.select(
            (F.col("o_orderkey") + 1).alias("order_id"),
            F.col("o_orderdate").alias("order_date"),
            F.col("o_orderpriority").alias("car"),
            # one customer in eleven orders with a card number that no card has
            (F.col("o_custkey") + F.when(F.col("o_custkey") % 11 == 0, 1000000000).otherwise(0))
            .cast("string").alias("card_number"),
            F.when(F.col("o_custkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_custkey") % 16)
            .cast("int").alias("percent_off"),
        ),
        "order_services": li.where(F.col("l_returnflag") != F.lit("N")).select(
            (F.col("l_orderkey") + 1).alias("order_id"),
            F.col("l_linenumber").alias("order_line"),
            (F.col("l_partkey") + 1).alias("service_id"),
            dec("l_extendedprice").alias("price"),
            dec("l_quantity").alias("quantity"),
        ),
        "order_materials": li.where(F.col("l_returnflag") == F.lit("N")).select(
            (F.col("l_orderkey") + 1).alias("order_id"),
            F.col("l_linenumber").alias("order_line"),
            (F.col("l_partkey") + 1).alias("material_id"),
            dec("l_quantity").alias("quantity"),
        ),
        "order_staffers": li.select(
            (F.col("l_orderkey") + 1).alias("order_id"),
            F.col("l_linenumber").alias("order_line"),
            (F.col("l_suppkey") + 1).alias("staffer_id"),
            F.col("l_quantity").cast("int").alias("ktu"),
        ),
        "purchases": ev.select(
            (F.col("event_id") + 1).alias("purchase_id"),
            F.expr("ts - INTERVAL 25 YEARS").alias("purchase_date"),
            F.col("event_type").alias("trader"),
            (F.col("event_id") % 200 + 1).alias("material_id"),
            dec("value").alias("price"),
            (F.col("event_id") % 5 + 1).cast(MONEY).alias("quantity"),
            F.lit(None).cast(MONEY).alias("sum"),
        ),
    }
    # Each select yields exactly the declared column names and types
    # (tests/test_testdata.py); nullability is not forced: Spark only
    # enforces it on write, and the integrity check reports violations.
    return tables


# The same derivations in SQL, as WITH clauses for the DuckDB oracles.
VIEW_SQL = {
    "v_staffers": """select s_suppkey + 1 as staffer_id, s_name as staffer_name,
        case when s_suppkey % 10 = 0 then 'manager' else 'mechanic' end as role,
        concat('user', cast(s_suppkey as varchar)) as login from supplier""",
    "v_discount_cards": """select cast(c_custkey as varchar) as card_number, c_name as customer_name,
        concat('+', lpad(cast(c_custkey as varchar), 10, '0')) as customer_telephone,
        cast(c_custkey % 16 as integer) as percent_off from customer""",
    "v_services": """select p_partkey + 1 as service_id, p_name as service_name,
        cast(p_retailprice as decimal(10,2)) as price from part""",
    "v_materials": """select p_partkey + 1 as material_id, p_name as material_name, p_size % 2 = 0 as part,
        'pcs' as measure, p_brand as article from part""",
    "v_orders": """select o_orderkey + 1 as order_id, o_orderdate as order_date, o_orderpriority as car,
        cast(o_custkey + case when o_custkey % 11 = 0 then 1000000000 else 0 end as varchar) as card_number,
        cast(case when o_custkey % 7 = 0 then null else o_custkey % 16 end as integer) as percent_off from orders""",
    "v_order_services": """select l_orderkey + 1 as order_id, l_linenumber as order_line, l_partkey + 1 as service_id,
        cast(l_extendedprice as decimal(10,2)) as price, cast(l_quantity as decimal(10,2)) as quantity
        from lineitem where l_returnflag <> 'N'""",
    "v_order_materials": """select l_orderkey + 1 as order_id, l_linenumber as order_line, l_partkey + 1 as material_id,
        cast(l_quantity as decimal(10,2)) as quantity from lineitem where l_returnflag = 'N'""",
    "v_order_staffers": """select l_orderkey + 1 as order_id, l_linenumber as order_line, l_suppkey + 1 as staffer_id,
        cast(l_quantity as integer) as ktu from lineitem""",
    "v_purchases": """select event_id + 1 as purchase_id, ts - interval '25' year as purchase_date,
        event_type as trader, event_id % 200 + 1 as material_id, cast(value as decimal(10,2)) as price,
        cast(event_id % 5 + 1 as decimal(10,2)) as quantity, cast(null as decimal(10,2)) as sum from events""",
}


def with_views(body: str) -> str:
    """Prefix an oracle query with the WITH clauses of the views it uses.

    A body that starts with its own ``with`` gets the views in front of its
    common table expressions.
    """
    used = [n for n in VIEW_SQL if n in body]
    ctes = ",\n".join(f"{n} as ({VIEW_SQL[n]})" for n in used)
    text = body.strip()
    if text[:5].lower() == "with ":
        return f"with {ctes},\n{text[5:]}"
    return f"with {ctes}\n{text}"


__all__ = ["shop_tables", "VIEW_SQL", "with_views"]
