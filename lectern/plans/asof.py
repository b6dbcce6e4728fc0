"""As-of joins: the latest right row at or before each left row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, forward: bool = False) -> DataFrame:
    """left columns and those of right that are not in `by`; null where no right row stands at or before (forward: at or after).

    Both sides are unioned and sorted once per key, so the work is one shuffle and a running `last`, and no pair is ever formed.
    Of right rows with one position the one that sorts last by its columns counts.
    """
    extra = [c for c in right.columns if c not in by]
    keep = [c for c in left.columns if c not in by]
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    a = left.select(*by, F.col(left_on).alias("_at"), F.lit(1).alias("_side"), F.struct(*keep).alias("_left"), F.lit(None).cast(right.select(F.struct(*extra).alias("x")).schema["x"].dataType).alias("_right"))
    b = right.select(*by, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*keep).alias("x")).schema["x"].dataType).alias("_left"), F.struct(*extra).alias("_right"))
    order = [F.col("_at").desc(), F.col("_side"), F.col("_right").desc()] if forward else [F.col("_at"), F.col("_side"), F.col("_right")]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select(*by, *[F.col(f"_left.{c}").alias(c) for c in keep], *[F.col(f"_right.{c}").alias(c) for c in extra])
