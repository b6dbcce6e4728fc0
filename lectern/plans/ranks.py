"""Order statistics that need no list of all values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept


def upper_median_by_counts(rows: DataFrame, by: str | list[str], value: str) -> DataFrame:
    """(by, median): the value at place floor(n/2) of each group in ascending order, from counts of distinct values."""
    by = [by] if isinstance(by, str) else by
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).count()
    w = Window.partitionBy(*by)
    upto = counts.withColumn("upto", F.sum("count").over(w.orderBy(value))).withColumn("n", F.sum("count").over(w))
    return upto.filter(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*by).agg(F.min(value).alias("median"))


def global_places(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place, counted from 1 in the given order over the whole table.

    Sorted ranges are written once, each row with its range and its place in it, and then read as often as needed: range bounds are
    drawn from samples, so two plans of one exchange need not agree. Places are shifted by the sizes of the ranges before, a table of one
    row per range. Columns named _range, _own or _before are not allowed.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = kept(sorted_.withColumn("_range", F.spark_partition_id()).withColumn("_own", inside), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = sizes.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(before, "_range").withColumn("place", F.col("_own") + F.col("_before") + 1).drop("_own", "_before", "_range")
