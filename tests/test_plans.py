"""Plan shapes the operators are designed for (sf0.001 tables)."""

import pytest

from overhaul import suite
from overhaul.plans import count_nodes, forbidden_nodes, scans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_no_pairwise_joins(spark, name):
    assert forbidden_nodes(suite.QUERIES[name](spark, SF)) == []


def test_works_report_prunes_and_pushes(spark):
    df = suite.QUERIES["executed_works"](spark, SF)
    by_table = {s.location.rsplit("/", 1)[-1]: s for s in scans(df)}
    orders = by_table["orders.parquet"]
    assert "GreaterThanOrEqual(o_orderdate,1999-01-01T00:00)" in orders.pushed_filters
    assert "LessThan(o_orderdate,1999-02-01T00:00)" in orders.pushed_filters
    assert set(orders.columns) == {"o_orderkey", "o_custkey", "o_orderdate"}
    assert set(by_table["lineitem.parquet"].columns) == {
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"}
    # three aggregation rounds and the final sort; joins to the small sides
    # are left to AQE (broadcast when the runtime size is under the threshold)
    assert count_nodes(df, "Exchange") <= 4


def test_balance_is_single_pass(spark):
    df = suite.QUERIES["materials_using"](spark, SF)
    # each movement source is scanned once; one full outer join to the catalogue
    assert len(scans(df)) == 4
    assert count_nodes(df, "SortMergeJoin") + count_nodes(df, "BroadcastHashJoin") + \
        count_nodes(df, "ShuffledHashJoin") == 2


def test_pay_report_scans_each_input_once(spark):
    df = suite.QUERIES["salary"](spark, SF)
    assert count_nodes(df, "Expand") == 1
    names = sorted(s.location.rsplit("/", 1)[-1] for s in scans(df))
    assert names.count("lineitem.parquet") == 2     # staff lines and service lines
    assert names.count("supplier.parquet") == 1


def test_document_lists_grouped_before_header_join(spark):
    from overhaul.operators.orders import order_documents
    from overhaul.sources.testdata import shop_tables
    df = order_documents(shop_tables(spark, SF), "1999-01-01", "1999-01-31")
    assert count_nodes(df, "ObjectHashAggregate") == 6   # partial + final per list
