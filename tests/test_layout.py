"""Bucketed tables remove the shuffles of joins and aggregations on order_id."""

from overhaul.operators.orders import order_list
from overhaul.operators.reports import executed_works, materials_using, salary
from overhaul.plans import count_nodes
from overhaul.sources.layout import read_catalog_tables, save_catalog_tables
from overhaul.sources.testdata import shop_tables


def test_bucketed_layout_plans_fewer_exchanges(spark, tmp_path):
    plain = shop_tables(spark, "/root/testdata/sf0.001")
    save_catalog_tables(plain, "shop_layout_test", 4, location=str(tmp_path))
    bucketed = read_catalog_tables(spark, "shop_layout_test")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # force shuffle joins to compare
    try:
        for op in (lambda t: order_list(t, begin="1999-01-01"),
                   lambda t: salary(t, "1999-01-01", "1999-03-31", 10)):
            assert count_nodes(op(bucketed), "Exchange") < count_nodes(op(plain), "Exchange")
        for op in (lambda t: order_list(t, begin="1999-01-01"),
                   lambda t: salary(t, "1999-01-01", "1999-03-31", 10),
                   lambda t: executed_works(t, "1999-01-01", "1999-01-31"),
                   lambda t: materials_using(t, "1999-01-10", "1999-01-20")):
            assert sorted(op(bucketed).collect()) == sorted(op(plain).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
