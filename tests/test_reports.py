"""Hand-made cases for the three reports, results worked out from the SQL."""

from overhaul.operators.reports import executed_works, materials_using, salary
from tests.conftest import D, T


def test_works_group_by_name_count_lines_and_id_list(make_tables):
    t = make_tables(
        services=[(1, "Wash", D(10)), (2, "Wash", D(20)), (3, "Oil", D(5))],
        orders=[(2, T("2024-01-05 10:00"), "car", "c", 10), (10, T("2024-01-06 10:00"), "car", None, None),
                (11, T("2024-03-01 10:00"), "car", None, 0)],
        order_services=[(2, 1, 1, D("0.05"), D("0.50")), (10, 1, 2, D("0.05"), D("0.50")),
                        (10, 2, 2, D("1.00"), D("1.00")), (11, 1, 3, D("1"), D("1"))],
    )
    rows = {r.service_name: r for r in executed_works(t, "2024-01-01", "2024-01-31").collect()}
    assert set(rows) == {"Wash"}
    w = rows["Wash"]
    assert w.orders == 3 and w.order_ids == "10,2"
    assert w.sum == D("1.06")                   # 0.03 + 0.03 + 1.00
    assert w.discount_sum == D("0.02")          # only the order with 10 % has a net amount
    assert w.average_percent_off == 10.0 and w.max_percent_off == 10
    everything = executed_works(t).collect()
    assert [r.service_name for r in everything] == ["Oil", "Wash"]


def test_works_keeps_lines_of_unknown_service_without_dates(make_tables):
    t = make_tables(orders=[(1, T("2024-01-05 10:00"), None, None, 0)],
                    order_services=[(1, 1, 99, D(2), D(3))])
    r = executed_works(t).collect()
    assert len(r) == 1 and r[0].service_name is None and r[0].sum == D("6.00") and r[0].order_ids == "1"


def _balance_tables(make_tables):
    return make_tables(
        materials=[(1, "Bolt", True, "pcs", "a"), (2, "Nut", True, "pcs", "b"), (3, "Idle", False, "pcs", "c"),
                   (4, "Minus", True, "pcs", "d")],
        purchases=[(1, T("2024-01-01 09:00"), "t", 1, D(1), D(10), None),
                   (2, T("2024-01-10 00:00"), "t", 1, D(1), D(5), None),
                   (3, T("2024-01-20 23:59"), "t", 2, D(1), D(1), None),
                   (4, T("2024-01-21 00:00"), "t", 1, D(1), D(100), None)],
        orders=[(7, T("2024-01-02 08:00"), None, None, 0), (8, T("2024-01-15 08:00"), None, None, 0)],
        order_materials=[(7, 1, 1, D(3)), (8, 1, 1, D(2)), (8, 2, 2, D(1)), (8, 3, 4, D(1))],
    )


def test_balance(make_tables):
    rows = {r.material_name: r for r in materials_using(_balance_tables(make_tables), "2024-01-10", "2024-01-20").collect()}
    b = rows["Bolt"]
    assert (b.incoming_sum_begin, b.outgoing_sum_begin, b.balance_begin) == (D(10), D(3), D(7))
    assert (b.incoming_sum, b.outgoing_sum, b.balance_end) == (D(5), D(2), D(10))
    assert b.purchase_ids == "2" and b.order_ids == "8"
    idle = rows["Idle"]
    assert idle.purchase_ids is None and idle.order_ids is None and idle.balance_end == D(0)
    assert rows["Nut"].balance_end == D(0) and rows["Minus"].balance_end == D(-1)


def test_balance_available_only(make_tables):
    rows = materials_using(_balance_tables(make_tables), "2024-01-10", "2024-01-20", only_available=True).collect()
    assert [r.material_name for r in rows] == ["Bolt"]


def test_pay_details_collapse_but_subtotal_counts_both(make_tables):
    t = make_tables(
        staffers=[(5, "Ann", "mechanic", "ann")],
        orders=[(1, T("2024-01-05 10:00"), None, None, 0), (2, T("2024-01-06 10:00"), None, None, 0)],
        order_services=[(1, 1, 1, D("1234.50"), D(1))],
        order_staffers=[(1, 1, 5, 50), (1, 1, 5, 50), (2, 1, 5, 51)],
    )
    rows = salary(t, "2024-01-01", "2024-01-31", 10).collect()
    assert [(r.staffer_id, r.order_id) for r in rows] == [(5, 0), (5, 1), (5, 2)]
    total, d1, d2 = rows
    assert d1.zp == D("61.73") and d1.orders_sum == D("1234.50") and d1.staffer_name == ""
    assert d2.zp == D("0.00") and d2.orders_sum == D("0.00")   # order without services
    assert total.zp == D("123.46") and total.orders_sum == D("2469.00")
    assert total.ktu == D("50.33") and total.staffer_name == "Ann"


def test_balance_orphan_ids_split_like_the_full_join_chain(make_tables):
    t = make_tables(
        materials=[(1, "Bolt", True, "pcs", "a")],
        purchases=[(1, T("2024-01-01 09:00"), "t", 9, D(1), D(4), None),
                   (2, T("2024-01-12 09:00"), "t", 9, D(1), D(6), None)],
        orders=[(8, T("2024-01-15 08:00"), None, None, 0)],
        order_materials=[(8, 1, 9, D(1))],
    )
    rows = materials_using(t, "2024-01-10", "2024-01-20").collect()
    orphan = sorted([(r.incoming_sum_begin, r.incoming_sum, r.outgoing_sum, r.purchase_ids, r.order_ids)
                     for r in rows if r.material_name is None])
    assert orphan == sorted([(D(4), D(0), D(0), None, None), (D(0), D(6), D(0), "2", None),
                             (D(0), D(0), D(1), None, "8")])
    assert [r.balance_end for r in rows if r.material_name == "Bolt"] == [D(0)]


def test_works_hot_service_name_matches_brute_force(make_tables):
    # one service name carries 95 % of the lines, spread over many orders
    import datetime as dt
    from decimal import Decimal as Dec
    orders = [(i, T("2024-01-01 10:00") + dt.timedelta(hours=i % 500), None, None, (i % 9) or None)
              for i in range(1, 1201)]
    services = [(1, "Hot", D(1)), (2, "Cold", D(1))]
    lines = [(1 + (i * 7) % 1200, i, 1 if i % 20 else 2, D(f"{i % 50}.25"), D("1.50")) for i in range(2000)]
    t = make_tables(orders=orders, services=services, order_services=lines)
    got = {r.service_name: r for r in executed_works(t, "2024-01-01", "2024-01-31").collect()}
    pct = {o[0]: o[4] for o in orders}
    day_ok = {o[0] for o in orders if o[1] < T("2024-02-01 00:00")}
    for sid, name in ((1, "Hot"), (2, "Cold")):
        mine = [ln for ln in lines if ln[2] == sid and ln[0] in day_ok]
        ids = sorted({str(ln[0]) for ln in mine})
        assert got[name].order_ids == ",".join(ids)
        assert got[name].orders == len(mine)
        gross = sum((ln[3] * ln[4]).quantize(Dec("0.01"), rounding="ROUND_HALF_UP") for ln in mine)
        assert got[name].sum == gross
