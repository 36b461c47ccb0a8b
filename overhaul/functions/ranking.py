"""Row numbers over a whole DataFrame and within groups, without one task
holding a whole group.

``row_numbers`` numbers all rows 0, 1, 2, ... in a given order: rows are
range-partitioned and sorted by the order (a hot value of the leading column
is split across partitions by the following ones), each row takes its
partition index and its position inside the partition, the tagged rows are
written once to the shared checkpoint folder (so a re-run task sees the same
partitions), and per-partition counts — one small row per partition, a
proven size bound, the only broadcast — become offsets.

``positions_within`` turns that into a position inside each group: the
group's first number comes from a partial (map-side) ``min`` aggregation
and is joined back, so even a group holding a third of the rows is numbered
by many tasks (``functions.joins.split_join``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from overhaul.functions.joins import split_join
from overhaul.session import materialize


def number_as_returned(df: DataFrame, out: str = "position") -> DataFrame:
    """``df`` with each row's number (from 0) in the order in which ``df`` returns its rows.

    No sort is added: what comes out of the partitions, one after the other, is
    counted. So the numbers also show whether a sorted result really is sorted.
    """
    tagged = materialize(df.withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()), "rows")
    offsets = (tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
               .select("_pid", F.sum("_n").over(Window.orderBy("_pid")
                                               .rowsBetween(Window.unboundedPreceding, -1)).alias("_before")))
    first_in_partition = F.col("_pid").cast("long") * F.lit(1 << 33)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.coalesce(F.col("_before"), F.lit(0)) + (F.col("_mid") - first_in_partition))
            .drop("_pid", "_mid", "_before"))


def row_numbers(df: DataFrame, order: list[str | Column], out: str = "_row") -> DataFrame:
    return number_as_returned(df.repartitionByRange(*order).sortWithinPartitions(*order), out)


def positions_within(df: DataFrame, groups: list[str], order: list[str | Column],
                     out: str = "position") -> DataFrame:
    """0-based position of each row inside its group, in ``order``."""
    numbered = row_numbers(df, [*groups, *order], "_row")
    firsts = numbered.groupBy(*groups).agg(F.min("_row").alias("_first"))
    return (split_join(numbered, firsts, groups)
            .withColumn(out, (F.col("_row") - F.col("_first")).cast("int"))
            .drop("_row", "_first"))
