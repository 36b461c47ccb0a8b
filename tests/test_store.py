"""Snapshots: touched parts only, all or nothing, ids never given twice, refused requests."""

import shutil

import pytest
from pyspark.sql import functions as F

from overhaul.operators import changes, reports, stored
from overhaul.operators.integrity import check_tables
from overhaul.operators.requests import judged, rejected, valid
from overhaul.plans import plan_text, scan_files
from overhaul.schema import SCHEMAS
from overhaul.sources import store
from tests.conftest import D, T

SERVICES = "service_id long, service_name string, price decimal(10,2), seq long"
ORDER_TABLES = store.ORDER_TABLES


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def shop(spark):
    """80 orders over four months, 40 purchases over two, ten services, materials and staffers each."""
    day = lambda k: T(f"1999-0{k % 4 + 1}-{k % 27 + 1:02d} 08:00")
    data = {
        "staffers": [(k, f"s{k}", "mechanic", f"u{k}") for k in range(1, 11)],
        "discount_cards": [(str(k), f"c{k}", None, k) for k in range(5)],
        "services": [(k, f"service {k}", D(10 * k)) for k in range(1, 11)],
        "materials": [(k, f"material {k}", True, "pcs", "a") for k in range(1, 11)],
        "orders": [(k, day(k), "car", str(k % 7), k % 20) for k in range(1, 81)],
        "order_services": [(k, n, k % 9 + 1, D(5), D(n)) for k in range(1, 81) for n in range(1, 1 + k % 4)],
        "order_materials": [(k, 1, k % 8 + 1, D(k)) for k in range(1, 81, 2)],
        "order_staffers": [(k, 1, k % 6 + 1, 50) for k in range(1, 81)],
        "purchases": [(k, T(f"1999-0{k % 2 + 1}-{k % 27 + 1:02d} 12:00"), "t", k % 9 + 1, D(2), D(k), None) for k in range(1, 41)],
    }
    return {n: spark.createDataFrame(data[n], schema) for n, schema in SCHEMAS.items()}


@pytest.fixture(scope="module")
def filled(spark, shop, tmp_path_factory):
    folder = tmp_path_factory.mktemp("store") / "shop"
    store.create(spark, str(folder), shop, 4)
    return folder


@pytest.fixture
def root(filled, tmp_path):
    """A store of its own for each test: names in a manifest are relative to the store's folder."""
    return str(shutil.copytree(filled, tmp_path / "shop"))


def state(spark, root, names=SCHEMAS):
    snap = store.snapshot(spark, root)
    return {n: rows(store.read(spark, snap, n)) for n in names}


def test_tables_come_back_and_earlier_snapshots_stay(spark, shop, root):
    assert state(spark, root) == {n: rows(df) for n, df in shop.items()}
    first = store.snapshot(spark, root)
    stored.delete(spark, root, "orders", shop["orders"].where("order_id < 30").select("order_id"))
    assert store.snapshot(spark, root).version == 2
    assert rows(store.read(spark, store.snapshot(spark, root, 1), "orders")) == rows(shop["orders"])
    assert rows(store.read(spark, first, "order_services")) == rows(shop["order_services"])


def test_ten_requests_read_and_write_touched_parts_only(spark, shop, root, monkeypatch):
    ids = list(range(3, 13))
    requests = shop["purchases"].where(F.col("purchase_id").isin(ids)).withColumn("trader", F.lit("new")).withColumn("seq", F.col("purchase_id"))
    before = store.snapshot(spark, root)
    holders = store.read(spark, before, "purchases", cut=True).where(F.col("purchase_id").isin(ids)).select("month", "bucket").distinct()
    parts = {store.part_name(m, b) for m, b in holders.collect()}
    assert 1 < len(parts) < len(before.parts("purchases"))
    opened, plain = [], store.read
    monkeypatch.setattr(store, "read", lambda s, snap, name, p=None, cut=False: opened.append((name, p, cut)) or plain(s, snap, name, p, cut))
    after, refused = stored.save(spark, root, "purchases", requests)
    assert refused.count() == 0
    # whole rows come from the touched parts alone; the look-up of months stays in the buckets of the keys
    whole = [p for name, p, cut in opened if name == "purchases" and not cut]
    assert [set(p) for p in whole] == [parts]
    looked = next(p for name, p, cut in opened if name == "purchases" and cut)
    assert {p.split("/")[1] for p in looked} == {p.split("/")[1] for p in parts}
    changed = stored.written_files(before, after)
    assert set(changed["purchases"]) == parts and set(changed["purchase_sums"]) == parts
    assert not any(changed[n] for n in changed if n not in ("purchases", "purchase_sums"))
    files = lambda snap: set(plain(spark, snap, "purchases").inputFiles())
    assert all(any(p in f for p in parts) for f in files(before) ^ files(after))
    expected = changes.save_purchases(shop["purchases"], requests)
    assert rows(plain(spark, after, "purchases")) == rows(expected)


def test_inserts_touch_no_part(spark, shop, root):
    before = store.snapshot(spark, root)
    new = spark.createDataFrame([(0, "wash", D(1), 1), (None, "dry", D(2), 2)], SERVICES)
    after, _ = stored.save(spark, root, "services", new)
    held = {p: before.sets["services"].get(p, []) for p in after.parts("services")}
    assert all(after.sets["services"][p][:len(sets)] == sets for p, sets in held.items())
    assert set(rows(store.read(spark, after, "services"))) == set(rows(shop["services"])) | {(11, "wash", D(1)), (12, "dry", D(2))}


def order_docs(spark, shop):
    from overhaul.operators.orders import order_documents
    docs = order_documents(shop, "1999-02-01", "1999-03-31").where("order_id % 5 < 3")
    return docs.select(
        F.expr("case when order_id % 5 = 0 then 0 when order_id % 5 = 1 then order_id else order_id + 1000000 end").alias("order_id"),
        # one in two of the saved orders moves to another month
        F.when(F.col("order_id") % 2 == 0, F.expr("order_date + interval 60 days")).otherwise(F.col("order_date")).alias("order_date"),
        F.lit("saved").alias("car"), "card_number", "percent_off", "order_services", "order_materials", "order_staffers",
        F.col("order_id").alias("seq"))


def test_whole_orders_equal_the_plain_job(spark, shop, root):
    docs = order_docs(spark, shop)
    expected, refused = changes.save_orders(shop, docs)
    before = store.snapshot(spark, root)
    after, mine = stored.save_orders(spark, root, docs)
    assert {n: rows(store.read(spark, after, n)) for n in ORDER_TABLES} == {n: rows(expected[n]) for n in ORDER_TABLES}
    assert rows(mine.select("order_id", "seq")) == rows(refused.select("order_id", "seq"))
    assert after.marks["orders"] == 80 + docs.where("order_id = 0").count()
    untouched = set(before.parts("orders")) - set(stored.written_files(before, after)["orders"])
    assert untouched and all(before.sets["orders"][p] == after.sets["orders"][p] for p in untouched)
    full = reports.materials_using(expected, "1999-04-10", "1999-05-20")
    assert rows(reports.materials_using(store.read_all(spark, after, cut=True), "1999-04-10", "1999-05-20")) == rows(full)


def test_a_job_that_stops_between_two_tables_changes_nothing(spark, shop, root, monkeypatch):
    old, write, calls = state(spark, root), store._write, []

    def stops(*args):
        calls.append(args[2])
        if len(calls) == 3:
            raise RuntimeError("lost")
        return write(*args)

    monkeypatch.setattr(store, "_write", stops)
    with pytest.raises(RuntimeError):
        stored.save_orders(spark, root, order_docs(spark, shop))
    assert calls[:2] != [] and state(spark, root) == old
    monkeypatch.setattr(store, "_write", write)
    after, _ = stored.save_orders(spark, root, order_docs(spark, shop))
    assert after.version == 2 and after.marks["orders"] > 80


def test_of_two_writers_one_loses(spark, shop, root):
    seen = store.snapshot(spark, root)
    added = store.with_parts({"services": spark.createDataFrame([(11, "first", D(1))], SCHEMAS["services"])}, seen.buckets)
    other = store.with_parts({"services": spark.createDataFrame([(11, "second", D(1))], SCHEMAS["services"])}, seen.buckets)
    store.commit(spark, seen, added, {}, {"services": 11})
    with pytest.raises(store.Conflict):
        store.commit(spark, seen, other, {}, {"services": 11})
    now = state(spark, root, ["services"])["services"]
    assert (11, "first", D(1)) in now and not any(r[1] == "second" for r in now)
    after, _ = stored.save(spark, root, "services", spark.createDataFrame([(0, "second", D(1), 1)], SERVICES))
    assert (12, "second", D(1)) in rows(store.read(spark, after, "services"))


def test_ids_of_deleted_rows_do_not_come_back(spark, shop, root):
    stored.delete(spark, root, "services", spark.createDataFrame([(10,)], "service_id long"))
    after, _ = stored.save(spark, root, "services", spark.createDataFrame([(0, "new", D(1), 1)], SERVICES))
    assert 10 not in {r[0] for r in rows(store.read(spark, after, "services"))}
    assert (11, "new", D(1)) in rows(store.read(spark, after, "services"))
    stored.delete(spark, root, "services", spark.createDataFrame([(11,)], "service_id long"))
    assert store.snapshot(spark, root).marks["services"] == 11


def test_deletes_refuse_and_cascade_as_on_plain_tables(spark, shop, root):
    for name, column in (("materials", "material_id"), ("services", "service_id"), ("orders", "order_id")):
        keys = shop[name].where(f"{column} % 3 = 0").select(column).unionByName(spark.createDataFrame([(None,), (999,)], f"{column} long"))
        current = store.read_all(spark, store.snapshot(spark, root))
        expected, refused = changes.delete_rows({n: current[n] for n in SCHEMAS}, name, keys)
        expected, refused = {n: rows(df) for n, df in expected.items()}, rows(refused)
        after, mine = stored.delete(spark, root, name, keys)
        assert {n: rows(store.read(spark, after, n)) for n in SCHEMAS} == expected
        assert rows(mine) == refused


def test_refused_requests_and_their_rules(spark, shop, root):
    requests = spark.createDataFrame([
        (0, T("1999-01-01"), "a", 777, D(1), D(1), None, 1),       # unknown material
        (0, None, "a", None, D(1), D(1), None, 2),                 # no date, no material
        (5, None, "a", 1, D(1), D(1), None, 3),                    # known row, no date
        (999, None, "a", 777, D(1), D(1), None, 4),                # unknown row: nothing happens
        (6, T("1999-01-02"), "good", 2, D(1), D(1), D(9), 5),
        (6, T("1999-01-03"), "bad", 888, D(1), D(1), None, 6),     # the last request is refused, the one before wins
    ], SCHEMAS["purchases"].simpleString()[7:-1].replace(":", " ") + ", seq long")
    checked = judged(shop, "purchases", requests)
    faults = sorted((r.seq, r.rule, r.column_name) for r in rejected(checked).collect())
    assert faults == [(1, "references_materials", "material_id"), (2, "not_null", "material_id"), (2, "not_null", "purchase_date"),
                      (3, "not_null", "purchase_date"), (6, "references_materials", "material_id")]
    assert sorted(r.seq for r in valid(checked).collect()) == [4, 5]
    after, refused = stored.save(spark, root, "purchases", requests)
    assert sorted({r.seq for r in refused.collect()}) == [1, 2, 3, 6]
    found = {r.purchase_id: r for r in store.read(spark, after, "purchases").collect()}
    assert set(found) == set(range(1, 41)) and found[6].trader == "good" and found[6].sum is None


def test_amounts_beyond_the_column_are_refused(spark, shop):
    wide = spark.createDataFrame([(0, "x", D("123456789.00"), 1), (0, "y", D("99999999.994"), 2), (0, None, D(1), 3)],
                                 "service_id long, service_name string, price decimal(20,3), seq long")
    assert sorted((r.seq, r.rule, r.column_name) for r in rejected(judged(shop, "services", wide)).collect()) == [
        (1, "numeric_10_2", "price"), (3, "not_null", "service_name")]


@pytest.mark.parametrize("begin, end", [("1999-02-10", "1999-02-20"), ("1999-03-01", "1999-04-02"), ("1999-01-05", "1999-01-06"), ("2001-01-01", "2001-02-01")])
def test_reports_of_a_store_equal_those_of_plain_tables(spark, shop, root, begin, end):
    t = store.read_all(spark, store.snapshot(spark, root), cut=True)
    assert rows(reports.materials_using(t, begin, end)) == rows(reports.materials_using(shop, begin, end))
    assert rows(reports.executed_works(t, begin, end)) == rows(reports.executed_works(shop, begin, end))
    assert rows(reports.salary(t, begin, end, 10)) == rows(reports.salary(shop, begin, end, 10))


def test_one_month_opens_that_months_files_only(spark, shop, root):
    """Also without broadcasts: the month is a condition on the files' partition column."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        snap = store.snapshot(spark, root)
        t = store.read_all(spark, snap, cut=True)
        report = reports.executed_works(t, "1999-02-03", "1999-02-20")
        assert "month#" in plan_text(report, "extended")
        read = scan_files(report)
        february = lambda name: sum(p.startswith("month=199902/") for p in snap.parts(name))
        assert read["order_services"] == february("order_services") < len(snap.parts("order_services"))
        assert read["orders"] == february("orders")
        # the balance opens no movement before the first of its month: the months before come as sums
        balance = scan_files(reports.materials_using(t, "1999-02-10", "1999-02-20"))
        assert balance["order_materials"] == february("order_materials") and balance["purchases"] == february("purchases")
        assert balance["material_sums"] == sum(p.startswith("month=199901/") for p in snap.parts("material_sums"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_empty_store(spark, make_tables, tmp_path):
    root = f"{tmp_path}/empty"
    store.create(spark, root, make_tables(), 4)
    after, refused = stored.save(spark, root, "services", spark.createDataFrame([(0, "one", D(1), 1), (7, "ghost", D(1), 2)], SERVICES))
    assert rows(store.read(spark, after, "services")) == [(1, "one", D("1.00"))] and refused.count() == 0
    assert rows(store.read(spark, after, "orders")) == []


def test_check_of_a_change_equals_the_full_check(spark, shop, root, monkeypatch):
    first = store.snapshot(spark, root)
    before, _ = stored.delete(spark, root, "purchases", spark.createDataFrame([(4,)], "purchase_id long"))
    opened, plain = [], store.read
    with monkeypatch.context() as patched:
        patched.setattr(store, "read", lambda s, snap, name, p=None, cut=False: opened.append((name, p)) or plain(s, snap, name, p, cut))
        assert stored.violations(spark, first, before).count() == 0
    assert all(p == [] for name, p in opened if name in ("order_services", "order_staffers"))
    lines = spark.createDataFrame([(5, 9, 777, D(1), D(1)), (500, 1, 1, D(1), D(1)), (6, 8, 3, None, None)], SCHEMAS["order_services"])
    parts = stored.touched(spark, before, "materials", spark.createDataFrame([(3,)], "material_id long"))
    left = store.read(spark, before, "materials", parts).where("material_id <> 3")
    double = shop["orders"].where("order_id = 7").withColumn("order_date", F.lit(None).cast("timestamp_ntz"))
    new = store.with_parts({"orders": shop["orders"], "order_services": lines, "materials": left}, before.buckets)
    new["orders"] = store.with_parts({"orders": double}, before.buckets)["orders"]
    after = store.commit(spark, before, new, {"materials": parts})
    full = check_tables(store.read_all(spark, after))
    assert rows(stored.violations(spark, before, after)) == rows(full) and full.count() == 5


def test_many_order_lines_are_shuffled_once(spark, shop, tmp_path, monkeypatch):
    """orders are never sent whole to every task; lines of a large new store stay where the join leaves them."""
    gathered, plain = {}, store._write
    monkeypatch.setattr(store, "_write", lambda s, snap, n, df, gather=True: gathered.update({n: gather}) or plain(s, snap, n, df, gather))
    monkeypatch.setattr(store, "SPREAD_ROWS", 50)
    root = f"{tmp_path}/large"
    snap = store.create(spark, root, shop, 2)
    assert {n for n, g in gathered.items() if not g} == {"order_services", "order_staffers"}  # 120 and 80 lines; 40 of materials
    assert state(spark, root) == {n: rows(df) for n, df in shop.items()}
    monkeypatch.setattr(store, "SPREAD_ROWS", 0)
    t = store.read_all(spark, store.create(spark, f"{tmp_path}/larger", shop, 2), cut=True)
    assert not gathered["material_sums"] and not gathered["order_materials"]
    assert rows(reports.materials_using(t, "1999-02-10", "1999-02-20")) == rows(reports.materials_using(shop, "1999-02-10", "1999-02-20"))
    after, _ = stored.delete(spark, root, "orders", shop["orders"].where("order_id < 30").select("order_id"))
    assert rows(store.read(spark, after, "order_services")) == rows(shop["order_services"].where("order_id >= 30"))
    lines = store.with_parts({n: store.read(spark, snap, n) for n in ORDER_TABLES}, 2)["order_services"]
    text = plan_text(store._laid_out(spark, "order_services", lines, False), "simple")
    assert "SortMergeJoin" in text and "Broadcast" not in text
    assert text.count("Exchange hashpartitioning") == 2


def test_keys_of_parents_are_not_sent_whole(spark, shop):
    """a task that judges requests holds no copy of all keys."""
    requests = shop["purchases"].withColumn("seq", F.col("purchase_id"))
    text = plan_text(judged(shop, "purchases", requests), "simple")
    assert text.count("SortMergeJoin") == 2 and "Broadcast" not in text
