"""Dense numbers over whole tables without a window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import materialize


def _bases(sizes: DataFrame, group: list[str]) -> DataFrame:
    """``sizes(group, _n)`` with ``_base``, the sum of _n of all groups before: ranges of groups are summed apart, and each adds what
    the ranges before it have. One number a range reaches the driver."""
    ranged = materialize(sizes.repartitionByRange(*group).withColumn("_range", F.spark_partition_id()), "group-ranges")
    before, total = [], 0
    for row in sorted(ranged.groupBy("_range").agg(F.sum("_n").alias("n")).collect()):
        before.append((row["_range"], total))
        total += row["n"]
    up = W.partitionBy("_range").orderBy(*group).rowsBetween(W.unboundedPreceding, -1)
    ranges = sizes.sparkSession.createDataFrame(before, "_range int, _before long")
    own = ranged.withColumn("_base", F.coalesce(F.sum("_n").over(up), F.lit(0))).join(ranges, "_range")
    return own.select(*group, (F.col("_base") + F.col("_before")).alias("_base"))


def number_rows(df: DataFrame, group: list[str], order: list[Column | str], out: str, start: int = 1, within: list[str] | None = None) -> DataFrame:
    """``out`` = start, start + 1, ... over all rows (of each ``within`` key), by ``group`` columns and then ``order``.

    Rows are numbered within their group; groups' sizes, one row a group, are summed in order and joined back. So windows hold
    one group, one range of groups, or the groups of one ``within`` key. Groups must not be null.
    """
    within = within or []
    sizes = df.groupBy(*within, *group).agg(F.count("*").alias("_n"))
    if within:
        by = W.partitionBy(*within).orderBy(*group)
        bases = sizes.withColumn("_base", F.sum("_n").over(by.rowsBetween(W.unboundedPreceding, -1))).drop("_n")
    else:
        bases = _bases(sizes, group)
    own = F.row_number().over(W.partitionBy(*within, *group).orderBy(*order))
    joined = df.withColumn("_own", own).join(bases, [*within, *group])
    return joined.withColumn(out, (F.coalesce("_base", F.lit(0)) + F.col("_own") + (start - 1)).cast("long")).drop("_own", "_base")


def number_distinct(values: DataFrame, column: str, out: str, parts: int | None = None) -> DataFrame:
    """(column, out): 1, 2, ... over the distinct values in sorted order, for tables too large for one window.

    Values are range-partitioned and sorted; each range counts itself, the few counts are summed, and rows add their
    range's base.
    """
    sizes = values.select(column).distinct().withColumn("_n", F.lit(1))
    if parts:
        sizes = sizes.repartition(parts, column)
    return _bases(sizes, [column]).select(column, (F.col("_base") + 1).alias(out))
