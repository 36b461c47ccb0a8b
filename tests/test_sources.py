import pytest
from pyspark.sql import functions as F

from overhaul.sources.tables import read_table, table_path, write_table
from tests.conftest import D, T


def test_write_coerces_money_and_versions(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "Wash", 10.125), (2, "Oil", -0.005)], "service_id long, service_name string, price double")
    p1 = write_table(df, root, "services")
    p2 = write_table(df.where("service_id = 1"), root, "services")
    assert p1.endswith("v=1") and p2.endswith("v=2")
    assert table_path(spark, root, "services") == p2                 # readers take the latest
    assert read_table(spark, root, "services", version=1).count() == 2
    rows = {r.service_id: r.price for r in read_table(spark, root, "services", version=1).collect()}
    assert rows == {1: D("10.13"), 2: D("-0.01")}                    # half away from zero
    assert dict(read_table(spark, root, "services").dtypes)["price"] == "decimal(10,2)"


def test_write_rejects_values_that_do_not_fit(spark, tmp_path):
    df = spark.createDataFrame([(1, "Big", 123456789.0)], "service_id long, service_name string, price double")
    with pytest.raises(Exception):
        write_table(df, str(tmp_path), "services")


def test_write_keeps_only_declared_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "Oil", True, "l", "a", "extra")],
                               "material_id long, material_name string, part boolean, measure string, article string, x string")
    write_table(df.withColumn("material_id", F.col("material_id")), str(tmp_path), "materials")
    assert read_table(spark, str(tmp_path), "materials").columns == [
        "material_id", "material_name", "part", "measure", "article"]


def test_export_json_records(spark, tmp_path):
    import json
    from overhaul.sources import export_json
    df = spark.createDataFrame([(1, D("10.50"), T("2024-01-02 03:04:05"))], "id long, total decimal(38,2), ts timestamp_ntz")
    out = export_json(df, str(tmp_path / "out"))
    rows = [json.loads(line) for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines()]
    assert rows == [{"id": 1, "total": 10.5, "ts": "2024-01-02T03:04:05"}]
    assert out.endswith("out")


def test_saved_tables_are_range_clustered(spark, tmp_path):
    import pyarrow.parquet as pq
    from overhaul.operators.reports import executed_works
    from overhaul.sources.tables import read_tables, save_tables
    from overhaul.sources.testdata import shop_tables
    src = shop_tables(spark, "/root/testdata/sf0.001")
    paths = save_tables(src, str(tmp_path), files=4)
    ranges = []
    for f in sorted((tmp_path / "order_services").glob("v=1/part-*.parquet")):
        ids = pq.read_table(f, columns=["order_id"]).column(0).to_pylist()
        ranges.append((min(ids), max(ids)))
    ranges.sort()
    assert len(ranges) > 1 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
    back = read_tables(spark, str(tmp_path))
    assert paths["orders"].endswith("v=1")
    assert sorted(executed_works(back, "1999-01-01", "1999-01-31").collect()) == \
        sorted(executed_works(src, "1999-01-01", "1999-01-31").collect())
