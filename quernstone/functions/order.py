"""Numbers and running sums along an order, without gathering the rows in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive keys whose running sum one task makes.
SPAN = 1 << 16


def numbered(rows: DataFrame, order: str, kept: Callable[[DataFrame, str], DataFrame], name: str = "k") -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... in order of the distinct values of column ``order``.

    Rows are dealt to ranges, which ``kept`` writes down, as ranges are drawn anew each time; a range counts its own rows and starts after all before it.
    """
    dealt = kept(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    placed = dealt.withColumn("_own", own).join(sizes.select("_range", before.alias("_before")), "_range")
    return placed.withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_range", "_own", "_before")


def sums_before(rows: DataFrame, key: str, value: str, name: str = "base", start: int = 0) -> DataFrame:
    """(key, name): ``start`` and the sum of ``value`` over all smaller keys. ``key`` holds whole numbers from 0, each once."""
    span = rows.select(key, value, F.floor(F.col(key) / SPAN).alias("_span"))
    upto = (Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_span").orderBy(key).rowsBetween(*upto)), F.lit(0))
    spans = span.groupBy("_span").agg(F.sum(value).alias("_sum"))
    outside = F.coalesce(F.sum("_sum").over(Window.orderBy("_span").rowsBetween(*upto)), F.lit(0))  # a row for each span
    joined = span.withColumn("_inside", inside).join(spans.select("_span", outside.alias("_outside")), "_span")
    return joined.select(key, (F.lit(start) + F.col("_inside") + F.col("_outside")).cast("long").alias(name))
