from overhaul.schema import SCHEMAS
from overhaul.sources.testdata import shop_tables


def test_views_have_declared_names_and_types(spark):
    t = shop_tables(spark, "/root/testdata/sf0.001")
    for name, schema in SCHEMAS.items():
        assert [(f.name, f.dataType) for f in t[name].schema.fields] == \
            [(f.name, f.dataType) for f in schema.fields], name


def test_definitions_shared_per_session(spark):
    a = shop_tables(spark, "/root/testdata/sf0.001")
    b = shop_tables(spark, "/root/testdata/sf0.001/")
    assert a["orders"] is b["orders"]
