"""Optional predicates of the listings and reports.

Each builder returns a Column (or None when the filter is not requested);
``where_all`` conjoins only those supplied. Date predicates compare the raw
timestamp with day boundaries so Parquet receives them as pushed range
filters (and partition pruning applies when tables are laid out by date).
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_of(value) -> dt.date | None:
    """Parse a day parameter; '' and None mean "not given".

    Text must be a whole ISO date or timestamp (a timestamp stands for its
    day); anything else raises ValueError.
    """
    if value is None or value == "":
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.datetime.fromisoformat(str(value).strip()).date()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def in_days(col, begin=None, end=None) -> Column | None:
    """date(col) >= begin AND date(col) <= end, each end optional.

    Expressed as ``col >= begin 00:00`` and ``col < (end + 1 day) 00:00``.
    """
    b, e = day_of(begin), day_of(end)
    preds = []
    if b is not None:
        preds.append(_c(col) >= F.lit(b))
    if e is not None:
        preds.append(_c(col) < F.lit(e + dt.timedelta(days=1)))
    return reduce(and_, preds) if preds else None


def in_months(df: DataFrame, begin=None, end=None) -> DataFrame:
    """``df`` cut to the months that [begin, end] touches, if it is laid out by ``month`` (199901); else ``df``.

    The condition is on the partition column itself, so the files of other
    months are neither listed for the scan nor opened.
    """
    if "month" not in df.columns:
        return df
    b, e = day_of(begin), day_of(end)
    if b is not None:
        df = df.where(F.col("month") >= b.year * 100 + b.month)
    if e is not None:
        df = df.where(F.col("month") <= e.year * 100 + e.month)
    return df


def before_day(col, day) -> Column:
    """date(col) < day."""
    d = day_of(day)
    if d is None:
        raise ValueError("a day is required")
    return _c(col) < F.lit(d)


def name_contains(col, text, collation: str | None = None) -> Column | None:
    """Case-insensitive substring test; '' or None means no filter.

    With a collation (one of Spark's, such as ``ru_CI`` or ``UNICODE_CI``) it
    decides which letters are equal instead of the upper case of both sides.
    """
    if text is None or text == "":
        return None
    if collation:
        return F.contains(F.collate(_c(col), collation), F.collate(F.lit(str(text)), collation))
    return F.upper(_c(col)).contains(F.upper(F.lit(str(text))))


def by_name(col, collation: str | None = None) -> Column:
    """Sort key of a name, NULLs last: by bytes, or as a collation orders text."""
    return F.asc_nulls_last(F.collate(_c(col), collation) if collation else _c(col))


def equals_unless(col, value, none_value) -> Column | None:
    """col = value, unless value is the "no filter" sentinel (None too)."""
    if value is None or value == none_value:
        return None
    return _c(col) == F.lit(value)


def where_all(df: DataFrame, *preds: Column | None) -> DataFrame:
    """Filter by the conjunction of the predicates that are not None."""
    given = [p for p in preds if p is not None]
    return df.where(reduce(and_, given)) if given else df
