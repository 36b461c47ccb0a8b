"""Joins whose large side can be split when one key holds many of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` for a ``right`` side that comes out of an
    aggregation, or a result that is aggregated by the same keys next.

    Spark splits a hot key's partition only if the join reads both sides right
    from a shuffle of its own, and no aggregation above relies on the join's
    partitioning. Joining on the keys as one struct gives both: the aggregated
    side (one row per key) is shuffled once more, and an aggregation above sums
    partially before its own shuffle.
    """
    on = F.struct(*keys)
    a = left.withColumn("_on", on)
    b = right.select(on.alias("_other"), *[c for c in right.columns if c not in keys])
    return a.join(b, a["_on"] == b["_other"], how).drop("_on", "_other")
