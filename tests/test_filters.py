import datetime as dt

import pytest

from overhaul.functions.filters import before_day, day_of, in_days, name_contains, where_all, equals_unless
from tests.conftest import T


def test_day_range_includes_whole_end_day(spark):
    df = spark.createDataFrame([(T("2024-01-31 23:59:59"),), (T("2024-02-01 00:00:00"),), (T("2023-12-31 23:59:59"),)],
                               "ts timestamp_ntz")
    got = where_all(df, in_days("ts", "2024-01-01", "2024-01-31")).collect()
    assert [r.ts for r in got] == [T("2024-01-31 23:59:59")]
    assert where_all(df, in_days("ts", None, None)).count() == 3
    assert df.where(before_day("ts", "2024-01-01")).count() == 1


def test_date_filter_reaches_parquet(spark, tmp_path):
    df = spark.createDataFrame([(T("2024-01-31 10:00:00"),)], "ts timestamp_ntz")
    df.write.parquet(str(tmp_path / "t"))
    plan = where_all(spark.read.parquet(str(tmp_path / "t")), in_days("ts", "2024-01-01", "2024-01-31"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text


def test_name_contains_any_case_cyrillic(spark):
    df = spark.createDataFrame([("Масло",), ("Фильтр",)], "name string")
    assert [r.name for r in df.where(name_contains("name", "мас")).collect()] == ["Масло"]
    assert name_contains("name", "") is None


def test_sentinels_mean_no_filter():
    assert equals_unless("x", 0, 0) is None
    assert equals_unless("x", "", "") is None
    assert equals_unless("x", None, 0) is None


def test_bad_day_text_raises():
    for text in ("2024-01-05garbage", "2024-01-0599", "2024-13-01", "yesterday", "2024-01-05 25:00"):
        with pytest.raises(ValueError):
            day_of(text)
    assert day_of("2024-01-05") == day_of(" 2024-01-05T23:59:59 ") == day_of("2024-01-05 10:00:00") == dt.date(2024, 1, 5)


def test_names_by_collation(make_tables):
    from overhaul.operators.catalog import material_list, service_list
    names = ["яблоко", "Яма", "арбуз", "Ёлка", "ель", "Елка", "ZZ", "Straße"]
    t = make_tables(materials=[(k, n, True, None, None) for k, n in enumerate(names, 1)], services=[(k, n, None) for k, n in enumerate(names, 1)])
    listed = lambda **how: [r.material_name for r in material_list(t, **how).collect()]
    assert listed() == sorted(names)
    assert listed(collation="ru_CI") == ["арбуз", "Елка", "Ёлка", "ель", "яблоко", "Яма", "Straße", "ZZ"]
    assert listed(collation="UNICODE") == ["Straße", "ZZ", "арбуз", "Елка", "Ёлка", "ель", "яблоко", "Яма"]
    assert sorted(listed(name="ЕЛ")) == sorted(listed(name="ЕЛ", collation="ru_CI")) == ["Елка", "ель"]
    assert listed(name="елка", collation="UNICODE_CI_AI") == ["Ёлка", "Елка"] and listed(name="елка") == ["Елка"]
    assert [r.service_name for r in service_list(t, name="Я", collation="ru").collect()] == ["Яма"]
