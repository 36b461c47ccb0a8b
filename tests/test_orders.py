from overhaul.operators.orders import flatten_documents, order_documents, order_list
from tests.conftest import D, T


def _tables(make_tables):
    return make_tables(
        discount_cards=[("C1", "Bob", "+1", 10)],
        services=[(1, "Wash", D(10))],
        materials=[(1, "Oil", True, "l", "x")],
        staffers=[(5, "Ann", "mechanic", "ann")],
        orders=[(1, T("2024-01-05 10:00"), "car", "C1", 10), (2, T("2024-01-04 10:00"), "car", "X", None),
                (3, T("2024-01-06 10:00"), "car", "C1", 0)],
        order_services=[(1, 2, 1, D("0.05"), D("0.50")), (1, 1, 1, D("10"), D("1")), (2, 1, 1, None, D(1))],
        order_materials=[(1, 1, 1, D(2))],
        order_staffers=[(2, 1, 5, 100)],
    )


def test_order_list(make_tables):
    rows = order_list(_tables(make_tables)).collect()
    assert [r.order_id for r in rows] == [2, 1, 3]            # by date
    by = {r.order_id: r for r in rows}
    assert by[1].customer_telephone == "+1" and by[1].order_lines == 2
    assert by[1].total == D("10.03") and by[1].discounted_total == D("9.02")
    assert by[2].customer_telephone is None and by[2].total == D("0.00") and by[2].order_lines == 1
    assert by[3].order_lines == 0 and by[3].total == D("0.00") and by[3].customer_telephone == "+1"
    assert [r.order_id for r in order_list(_tables(make_tables), card_number="C1").collect()] == [1, 3]


def test_documents_sorted_lists_and_empty_arrays(make_tables):
    docs = {r.order_id: r for r in order_documents(_tables(make_tables)).collect()}
    assert [x.order_line for x in docs[1].order_services] == [1, 2]
    assert docs[1].order_services[1].sum == D("0.03") and docs[1].order_services[0].service_name == "Wash"
    assert docs[2].order_services[0].sum == D("0.00")         # missing price shows 0
    assert docs[3].order_services == [] and docs[3].order_materials == [] and docs[3].order_staffers == []
    assert docs[2].order_staffers[0].staffer_name == "Ann"
    flat = flatten_documents(order_documents(_tables(make_tables))).collect()
    empty = [r for r in flat if r.order_id == 3]
    assert len(empty) == 3 and all(r.position is None for r in empty)


def test_document_lines_equal_flattened_documents_with_a_hot_order(make_tables):
    from overhaul.operators.orders import document_lines
    t = make_tables(
        services=[(1, "Wash", D(10)), (2, "Oil", D(5))],
        staffers=[(5, "Ann", "mechanic", "ann")],
        orders=[(1, T("2024-01-05 10:00"), "big", None, 0), (2, T("2024-01-06 10:00"), "small", None, 0),
                (3, T("2024-01-07 10:00"), "empty", None, 0)],
        order_services=[(1, i % 37, 1 + i % 2, D(i % 11), D(1)) for i in range(600)] + [(2, 1, 2, D(3), D(2))],
        order_staffers=[(1, i % 5, 5, i % 3) for i in range(40)],
    )
    flat = flatten_documents(order_documents(t)).collect()
    lines = document_lines(t).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, lines)) == sorted(map(key, flat))
    assert sorted(r.position for r in lines if r.order_id == 1 and r.kind == "service") == list(range(600))


def test_order_list_counts_repeated_cards_like_the_join(make_tables):
    t = make_tables(
        discount_cards=[("C1", "Bob", "+1", 10), ("C1", "Bob", "+2", 10)],
        orders=[(1, T("2024-01-05 10:00"), "car", "C1", 0)],
        order_services=[(1, 1, 1, D("10"), D("1"))],
    )
    r = order_list(t).collect()[0]
    assert (r.customer_telephone, r.order_lines, r.total) == ("+2", 2, D("20.00"))
