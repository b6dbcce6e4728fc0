"""Interval joins: points and the spans that hold them, by equal keys and equal bins, never by a range condition alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(points: DataFrame, spans: DataFrame, by: list[str], at: str, lo: str, hi: str, width: int = 16) -> DataFrame:
    """All columns of points, and of spans those that are not in `by`, for each span of the key with lo <= at < hi.

    at, lo and hi are whole numbers. Spans are laid out over bins of `width`, so a point meets the spans of its own bin: an equi-join, which
    adaptive execution splits when a key or bin is hot. Points in no span, in spans without end or with null positions are left out;
    spans may overlap. Column names must differ but for `by`.
    """
    binned = spans.filter(F.col(hi) > F.col(lo)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    found = points.withColumn("_bin", F.floor(F.col(at) / width)).join(binned, [*by, "_bin"])
    return found.filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_bin")
