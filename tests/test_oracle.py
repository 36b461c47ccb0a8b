"""Every registered query equals its DuckDB oracle on the sf0.001 tables
(row count, column names, order-insensitive values), like the driver's gate."""

import datetime as dt
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from overhaul import suite

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def test_every_query_has_an_oracle():
    assert set(suite.QUERIES) == set(suite.ORACLES)
    assert set(suite.QUERIES) <= set(entry_module.queries())


def test_entry_smoke(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["sum", "orders", "average_percent_off", "max_percent_off", "service_name",
                          "order_ids", "discount_sum"]
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    cur = duck.execute(entry_module.oracle_sql()[name])
    ocols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(ocols, cur.fetchall())


@pytest.mark.parametrize("name", ["executed_works", "materials_using", "salary", "order_list",
                                  "order_documents", "save_orders", "integrity_violations"])
def test_query_matches_oracle_with_shuffle_joins(spark, duck, name):
    """The same answers when no side is broadcast (the large-scale plans)."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        test_query_matches_oracle(spark, duck, name)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
