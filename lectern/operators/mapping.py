"""Printed pages and global word offsets: calibration points, interpolation between them, extrapolation beyond."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_round
from ..plans.asof import asof_join

DEFAULT_WORDS_PER_PAGE, LEAST_WORDS_PER_PAGE = 280, 20


def latest_points(points: DataFrame) -> DataFrame:
    """(book_id, page, g): a later point (column at) for the same page replaces the earlier."""
    return points.groupBy("book_id", "page").agg(F.max_by("g", "at").alias("g"))


def book_facts(points: DataFrame, books: DataFrame) -> DataFrame:
    """books (book_id, total_words, total_pages) with wpp, first and last point and number of points."""
    ends = points.groupBy("book_id").agg(F.min(F.struct("page", "g")).alias("a"), F.max(F.struct("page", "g")).alias("z"), F.count("*").alias("n"))
    slope = (F.col("z.g") - F.col("a.g")) / (F.col("z.page") - F.col("a.page"))
    fits = (F.col("n") >= 2) & (F.col("z.page") != F.col("a.page")) & (F.col("z.g") != F.col("a.g"))
    by_pages = F.when((F.col("total_pages") > 0) & (F.col("total_words") > 0), F.col("total_words") / F.col("total_pages"))
    wpp = F.when(fits, F.greatest(F.lit(float(LEAST_WORDS_PER_PAGE)), slope)).otherwise(F.coalesce(by_pages, F.lit(float(DEFAULT_WORDS_PER_PAGE))))
    return books.join(ends, "book_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("wpp", wpp)


def quality(n, total_pages):
    return F.when(n >= 2, "good").when(n == 1, "rough").when(total_pages > 0, "estimate").otherwise("none")


def _intervals(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("book_id").orderBy("page")
    return points.select("book_id", "page", "g", F.lead("page").over(w).alias("page2"), F.lead("g").over(w).alias("g2"))


def page_to_global(asked: DataFrame, points: DataFrame, books: DataFrame) -> DataFrame:
    """asked (book_id, page) with g; null where a book has neither points nor a number of pages.

    A page at a control point takes the interval that ends there, as the first one that holds it does.
    """
    facts = book_facts(points, books)
    spans = _intervals(points).filter("page2 is not null").select("book_id", F.col("page").alias("p1"), "g", "page2", "g2")
    found = asof_join(asked.select("book_id", "page"), spans, ["book_id"], "page", "p1").withColumnRenamed("g", "g1").join(facts, "book_id")
    inner = F.col("g1") + (F.col("page") - F.col("p1")) / (F.col("page2") - F.col("p1")) * (F.col("g2") - F.col("g1"))
    g = (
        F.when(F.col("n") == 0, F.when(F.col("total_pages") > 0, (F.col("page") - 1) * F.col("wpp")))
        .when(F.col("page") <= F.col("a.page"), F.col("a.g") - (F.col("a.page") - F.col("page")) * F.col("wpp"))
        .when(F.col("page") >= F.col("z.page"), F.col("z.g") + (F.col("page") - F.col("z.page")) * F.col("wpp"))
        .otherwise(inner)
    )
    inside = F.when(g.isNotNull(), F.greatest(F.lit(0), F.least(js_round(g), "total_words")))  # both pass over nulls
    return found.select("book_id", "page", inside.alias("g"))


def global_to_page(asked: DataFrame, points: DataFrame, books: DataFrame) -> DataFrame:
    """asked (book_id, g) with page."""
    facts = book_facts(points, books)
    spans = _intervals(points).filter("page2 is not null").select("book_id", F.col("page").alias("p1"), F.col("g").alias("g1"), "page2", "g2")
    found = asof_join(asked.select("book_id", "g"), spans, ["book_id"], "g", "g1").join(facts, "book_id")
    t = F.when(F.col("g2") == F.col("g1"), 0.0).otherwise((F.col("g") - F.col("g1")) / (F.col("g2") - F.col("g1")))
    page = (
        F.when(F.col("n") == 0, F.when(F.col("total_pages") > 0, F.greatest(F.lit(1), F.floor(F.col("g") / F.col("wpp")) + 1)))
        .when(F.col("g") <= F.col("a.g"), F.greatest(F.lit(1), js_round(F.col("a.page") - (F.col("a.g") - F.col("g")) / F.col("wpp"))))
        .when(F.col("g") >= F.col("z.g"), js_round(F.col("z.page") + (F.col("g") - F.col("z.g")) / F.col("wpp")))
        .otherwise(js_round(F.col("p1") + t * (F.col("page2") - F.col("p1"))))
    )
    return found.select("book_id", "g", page.cast("long").alias("page"))
