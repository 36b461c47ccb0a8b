"""Hot keys: with broadcasts off, the joins of the listings, the pay report and the order cascade split a hot key's rows."""

import contextlib

import pytest
from pyspark.sql import functions as F

from overhaul.operators import changes, orders, reports
from overhaul.schema import SCHEMAS

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.shuffle.partitions": "16",
}
N = 30_000


@contextlib.contextmanager
def settings(spark, conf):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.fixture(scope="module")
def hot(spark):
    """70 % of the lines belong to order 1, 70 % of the orders to one card."""
    n = spark.range(1, N + 1, 1, 8)
    one = F.when(F.col("id") % 10 < 7, 1).otherwise(F.col("id"))
    line = {"order_id": one, "order_line": F.col("id") % 50, "service_id": F.col("id") % 90, "material_id": F.col("id") % 90,
            "staffer_id": F.col("id") % 90, "price": F.rand(1) * 100, "quantity": F.rand(2) * 10, "ktu": F.col("id") % 50}
    values = {
        "orders": {"order_id": F.col("id"), "order_date": F.lit("2024-01-01 10:00:00"), "car": F.sha2(F.col("id").cast("string"), 256),
                   "card_number": F.when(F.col("id") % 10 < 7, "7").otherwise(F.col("id")), "percent_off": F.col("id") % 20},
        "discount_cards": {"card_number": F.col("id"), "customer_name": F.col("id"), "customer_telephone": F.col("id"), "percent_off": F.lit(1)},
        "order_services": line, "order_materials": line, "order_staffers": line,
        "staffers": {"staffer_id": F.col("id"), "staffer_name": F.col("id"), "role": F.lit("r"), "login": F.col("id")},
    }
    return {t: n.select(*[values[t][f.name].cast(f.dataType).alias(f.name) for f in SCHEMAS[t].fields]) for t in values}


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


CASES = {
    "order_list": lambda t: orders.order_list(t),
    "salary_details": lambda t: reports.salary_details(t, "2024-01-01", "2024-01-31", 10),
    "cascade": lambda t: changes.delete_orders(t, t["orders"].where("order_id % 2 = 1"))["order_services"],
}


@pytest.mark.parametrize("name", CASES)
def test_hot_keys_are_split(spark, hot, name):
    with settings(spark, CONF):
        assert "skew=true" in final_plan(CASES[name](hot))
