from pyspark.sql import functions as F

from overhaul.functions.money import line_amount, line_amount_net, pay, round_avg
from tests.conftest import D


def _one(spark, rows, schema, *cols):
    return spark.createDataFrame(rows, schema).select(*cols).collect()


def test_half_cent_rounds_away_from_zero(spark):
    r = _one(spark, [(D("0.05"), D("0.50"), 10), (D("-0.05"), D("0.50"), 0)],
             "price decimal(10,2), quantity decimal(10,2), pct int",
             line_amount("price", "quantity").alias("g"), line_amount_net("price", "quantity", "pct").alias("n"))
    assert r[0].g == D("0.03") and r[0].n == D("0.02")
    assert r[1].g == D("-0.03")


def test_round_then_sum(spark):
    df = spark.createDataFrame([(D("0.05"), D("0.50"))] * 2, "price decimal(10,2), quantity decimal(10,2)")
    assert df.agg(F.sum(line_amount("price", "quantity"))).first()[0] == D("0.06")


def test_null_percent_gives_null_net(spark):
    r = _one(spark, [(D("10.00"), D("1"), None)], "price decimal(10,2), quantity decimal(10,2), pct int",
             line_amount_net("price", "quantity", "pct").alias("n"))
    assert r[0].n is None


def test_pay_exact(spark):
    r = _one(spark, [(50, D("1234.50")), (50, None)], "ktu int, s decimal(38,2)",
             pay("ktu", 10, "s").alias("zp"))
    assert r[0].zp == D("61.73")  # 61.725 rounds up
    assert r[1].zp == D("0.00")


def test_round_avg_exact_tie(spark):
    # 1001 / 40 = 25.025 exactly: half away from zero gives 25.03
    r = _one(spark, [(1001, 40), (5, 0)], "s long, n long", round_avg("s", "n").alias("a"))
    assert r[0].a == D("25.03") and r[1].a is None
