from pyspark.sql import functions as F

from overhaul.operators import changes as ch
from overhaul.operators.integrity import check_tables
from overhaul.schema import MATERIALS
from tests.conftest import D, T


def _materials(spark, rows):
    return spark.createDataFrame(rows, MATERIALS)


CHANGE_SCHEMA = "material_id long, material_name string, part boolean, measure string, article string, seq long"


def test_save_insert_update_unknown_and_last_wins(spark):
    m = _materials(spark, [(1, "Oil", True, "l", "a"), (2, "Nut", True, "pcs", "b")])
    changes = spark.createDataFrame([
        (0, "New", False, "pcs", "n", 5), (None, "New2", False, "pcs", "n", 3),
        (99, "Ghost", True, "x", "x", 1), (1, "Oil v1", True, "l", "a", 1), (1, "Oil v2", None, "l", "a", 2),
    ], CHANGE_SCHEMA)
    out = {r.material_id: r for r in ch.apply_saves(m, changes, "material_id").collect()}
    assert set(out) == {1, 2, 3, 4}
    assert out[1].material_name == "Oil v2" and out[1].part is None   # NULL is written too
    assert out[3].material_name == "New2" and out[4].material_name == "New"  # ids in request order
    assert out[2].material_name == "Nut"


def test_assign_ids_dense_across_partitions(spark):
    rows = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("seq")).repartition(13)
    out = ch.assign_ids(rows, "new_id", 100, "seq").collect()
    got = sorted((r.seq, r.new_id) for r in out)
    assert [i for _, i in got] == list(range(101, 5101))


def test_saves_twice_with_ids_is_idempotent(spark):
    m = _materials(spark, [(1, "Oil", True, "l", "a")])
    changes = spark.createDataFrame([(1, "Oil2", True, "l", "a", 1)], CHANGE_SCHEMA)
    once = ch.apply_saves(m, changes, "material_id")
    twice = ch.apply_saves(once, changes, "material_id")
    assert sorted(once.collect()) == sorted(twice.collect())


def test_insert_rejects_existing_and_later_duplicates(spark, make_tables):
    cards = make_tables(discount_cards=[("A", "x", None, 1)])["discount_cards"]
    req = spark.createDataFrame([("A", "dup", None, 2, 1), ("B", "first", None, 3, 2), ("B", "second", None, 4, 3)],
                                "card_number string, customer_name string, customer_telephone string, percent_off int, seq long")
    table, rejected = ch.apply_inserts(cards, req, "card_number")
    assert sorted((r.card_number, r.customer_name) for r in table.collect()) == [("A", "x"), ("B", "first")]
    assert sorted(r.customer_name for r in rejected.collect()) == ["dup", "second"]


def test_delete_cascade_and_restrict(make_tables, spark):
    t = make_tables(
        materials=[(1, "Oil", True, "l", "a"), (2, "Free", True, "l", "a")],
        orders=[(1, T("2024-01-05 10:00"), None, None, 0), (2, T("2024-01-05 10:00"), None, None, 0)],
        order_materials=[(1, 1, 1, D(1)), (2, 1, 1, D(1))],
        order_staffers=[(1, 1, 5, 10)],
    )
    keys = spark.createDataFrame([(1,)], "order_id long")
    after = ch.delete_orders(t, keys)
    assert [r.order_id for r in after["orders"].collect()] == [2]
    assert after["order_staffers"].count() == 0 and after["order_materials"].count() == 1
    mkeys = spark.createDataFrame([(1,), (2,)], "material_id long")
    table, rejected = ch.delete_restricted(t["materials"], mkeys, "material_id", [(t["order_materials"], "material_id")])
    assert [r.material_id for r in table.collect()] == [1] and [r.material_id for r in rejected.collect()] == [1]


def test_save_order_with_empty_lists_removes_children(make_tables, spark):
    from overhaul.schema import ORDER_DOCUMENT_INPUT
    t = make_tables(
        orders=[(1, T("2024-01-05 10:00"), "old", None, 0)],
        order_services=[(1, 1, 1, D(1), D(1))], order_staffers=[(1, 1, 5, 10)],
        services=[(7, "wash", D(2))], staffers=[(5, "Ann", "mechanic", "ann")],
    )
    docs = spark.createDataFrame(
        [(1, T("2024-01-06 10:00"), "new", None, 5, [], [], []),
         (0, T("2024-01-07 10:00"), "fresh", None, 0, [(1, 7, D(2), D(3))], [], [(1, 5, 20)]),
         (42, T("2024-01-07 10:00"), "ghost", None, 0, [], [], [])],
        ORDER_DOCUMENT_INPUT).withColumn("seq", F.monotonically_increasing_id())
    out, rejected = ch.save_orders(t, docs)
    orders = {r.order_id: r for r in out["orders"].collect()}
    assert orders[1].car == "new" and orders[2].car == "fresh" and set(orders) == {1, 2}
    assert [(r.order_id, r.service_id) for r in out["order_services"].collect()] == [(2, 7)]
    assert [(r.order_id, r.staffer_id) for r in out["order_staffers"].collect()] == [(2, 5)]
    assert [r.order_id for r in rejected.collect()] == [42]


def test_integrity_finds_each_rule(make_tables, spark):
    t = make_tables(
        materials=[(1, "Oil", True, "l", "a"), (1, "Dup", True, "l", "a")],
        orders=[(1, T("2024-01-05 10:00"), None, None, 0)],
        order_materials=[(1, 1, 9, D(1))],
    )
    t["services"] = spark.createDataFrame([(1, None, D("123456789.99"))],
                                          "service_id long, service_name string, price decimal(20,2)")
    got = {(r.table_name, r.rule, r.column_name, r.value) for r in check_tables(t).collect()}
    assert ("materials", "unique_key", "material_id", "1") in got
    assert ("order_materials", "references_materials", "material_id", "9") in got
    assert ("services", "not_null", "service_name", "1") in got
    assert ("services", "numeric_10_2", "price", "1") in got
    assert len(got) == 4


def test_rejected_orders_are_those_that_a_save_rejects(spark):
    from overhaul.sources.testdata import shop_tables
    from overhaul.suite import order_saves
    t = shop_tables(spark, "/root/testdata/sf0.001")
    _, rejected = ch.save_orders(t, order_saves(t))
    alone = ch.rejected_orders(t, order_saves(t))
    assert alone.columns == rejected.columns
    assert sorted(map(str, alone.collect())) == sorted(map(str, rejected.collect())) != []
