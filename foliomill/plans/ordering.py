"""Positions and running sums over one order of a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.plans.workspace import materialize


def positions(ordered: DataFrame) -> DataFrame:
    """``ordered``, which ends in a global sort, with ``position`` (from 0 in its order)."""
    return _numbered(ordered, ())


def running(table: DataFrame, order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """``table`` with ``position`` (from 0 in this order) and ``before_<c>`` (the sum of c over all earlier rows) for each of ``sums``.

    Rows are range-partitioned by the order and numbered within their range; the totals of
    the ranges, one row each, give the offsets. ``order`` should tell all rows apart, or
    ties fall as they come. An empty table stays empty.
    """
    return _numbered(table.orderBy(*order), sums)


def _numbered(table: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    placed = table.withColumn("_range", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id())
    placed = materialize(placed, "ordered")
    in_range = Window.partitionBy("_range").orderBy("_seq")
    earlier = in_range.rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = ranges.select("_range", start("_n").alias("_n"), *[start(f"_sum_{c}").alias(f"_sum_{c}") for c in sums])
    local = placed.withColumn("position", F.row_number().over(in_range) - 1)
    for c in sums:
        local = local.withColumn(f"before_{c}", F.coalesce(F.sum(c).over(earlier), F.lit(0)))
    out = local.join(F.broadcast(offsets), "_range")
    return out.select(*table.columns, (F.col("position") + F.col("_n")).cast("long").alias("position"), *[(F.col(f"before_{c}") + F.col(f"_sum_{c}")).alias(f"before_{c}") for c in sums])
