"""Invariants between operators on the sf0.001 tables."""

from pyspark.sql import functions as F

from overhaul.operators import changes as ch
from overhaul.operators.integrity import check_tables
from overhaul.operators.orders import order_list
from overhaul.operators.reports import executed_works, materials_using, salary, salary_details
from overhaul.sources.testdata import shop_tables

SF = "/root/testdata/sf0.001"


def test_balance_of_one_period_opens_the_next(spark):
    t = shop_tables(spark, SF)
    # names repeat across materials, so compare the (name, balance) multisets
    first = materials_using(t, "1999-01-01", "1999-01-15").select("material_name", F.col("balance_end").alias("b"))
    second = materials_using(t, "1999-01-16", "1999-01-31").select("material_name", F.col("balance_begin").alias("b"))
    assert first.exceptAll(second).count() == 0 and second.exceptAll(first).count() == 0
    assert first.where("b <> 0").count() > 0
    closing = materials_using(t, "1999-01-01", "1999-01-15").where(
        F.col("balance_end") != F.col("balance_begin") + F.col("incoming_sum") - F.col("outgoing_sum"))
    assert closing.count() == 0


def test_works_total_equals_order_totals(spark):
    t = shop_tables(spark, SF)
    works = executed_works(t).agg(F.sum("sum"), F.sum("discount_sum"), F.sum("orders")).first()
    orders = order_list(t).agg(F.sum("total"), F.sum("discounted_total"), F.sum("order_lines")).first()
    assert tuple(works) == tuple(orders)


def test_pay_subtotals_sum_all_detail_rows(spark):
    t = shop_tables(spark, SF)
    d = salary_details(t, "1999-01-01", "1999-12-31", 10)
    known = d.join(t["staffers"].select("staffer_id"), "staffer_id", "left_semi")
    expected = known.agg(F.sum("zp"), F.sum("orders_sum")).first()
    got = salary(t, "1999-01-01", "1999-12-31", 10).where("order_id = 0").agg(
        F.sum("zp"), F.sum("orders_sum")).first()
    assert tuple(got) == tuple(expected)


def test_cascade_leaves_no_orphans(spark):
    t = shop_tables(spark, SF)
    keys = t["orders"].where(F.col("car") == "1-URGENT").select("order_id")
    after = ch.delete_orders(t, keys)
    bad = check_tables(after).where(F.col("rule") == "references_orders")
    assert bad.count() == 0
    assert after["orders"].join(keys, "order_id", "left_semi").count() == 0
