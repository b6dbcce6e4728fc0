"""Catalog records: union of sources, deduplication, recommendation, enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_round, normalize
from .taste import first_author


def union(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources with a source column; columns that a source lacks are null, full_text false."""
    named = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return rows.withColumn("full_text", F.coalesce("full_text", F.lit(False))) if "full_text" in rows.columns else rows


def dedup(rows: DataFrame, priority: list[str]) -> DataFrame:
    """The first of each title and first author by source priority, then id; later ones stay only with full text."""
    key = F.concat_ws("|", normalize(F.col("title")), normalize(first_author(F.coalesce("author", F.lit("")))))
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("source"))
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(place, "id"))
    return rows.withColumn("_key", key).withColumn("_rank", rank).filter("_rank = 1 or full_text").drop("_key", "_rank")


def search_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("full_text").desc(), F.col("downloads").desc_nulls_last(), "id")


def recommend(candidates: DataFrame, subjects: DataFrame, authors: DataFrame, owned: DataFrame, finished: DataFrame, limit: int = 12) -> DataFrame:
    """The best candidates (id, title, author, subjects, rating, pages, full_text) with score and up to three reasons.

    subjects: at most 8 rows (key, name, weight, and ord, the order of equal weights; by key without it); authors: at most 2 rows (key, name).
    Both are broadcast for that reason.
    """
    from ..plans.ranks import upper_median_by_counts

    top = subjects.orderBy(F.col("weight").desc(), "key").limit(4) if "ord" not in subjects.columns else subjects.orderBy(F.col("weight").desc(), "ord").limit(4)
    seeds = F.broadcast(top.select("key", F.col("name").alias("subject"), (0.6 + F.col("weight")).alias("w")))
    known = F.broadcast(subjects.agg(F.collect_list("key").alias("known")))
    writers = F.broadcast(authors.select(F.col("key").alias("akey"), F.col("name").alias("writer")))
    rows = candidates.filter("title is not null").withColumn("keys", F.transform("subjects", normalize)).withColumn("akey", normalize(first_author(F.coalesce("author", F.lit("")))))
    by_subject = rows.select("id", F.explode("keys").alias("key")).join(seeds, "key").groupBy("id").agg(F.sum("w").alias("sw"), F.array_sort(F.collect_list(F.concat(F.lit("shares “"), "subject", F.lit("” with books you read")))).alias("why"))
    hit = rows.join(by_subject, "id", "left").join(writers, "akey", "left").filter("sw is not null or writer is not null")
    hit = hit.withColumn("t", normalize(F.col("title"))).join(owned.select(normalize(F.col("title")).alias("t")).distinct(), "t", "left_anti")
    mine = owned.select(normalize(first_author(F.coalesce("author", F.lit("")))).alias("akey")).distinct().withColumn("mine", F.lit(True))
    median = F.broadcast(upper_median_by_counts(finished.select(F.lit("all").alias("set"), "pages"), "set", "pages").agg(F.max("median").alias("pref")))
    hit = hit.join(mine, "akey", "left").join(known).join(median)  # one row each
    ratio = F.col("pages") / F.col("pref")
    fits = F.coalesce((ratio > 0.6) & (ratio < 1.6), F.lit(False))
    overlap = F.least(F.lit(4), F.size(F.array_intersect("keys", "known")))
    score = (
        F.coalesce("sw", F.lit(0.0)) + F.when(F.col("writer").isNotNull(), 1.1).otherwise(0.0) + overlap * 0.3 + F.when(F.col("full_text"), 0.7).otherwise(0.0)
        + F.coalesce((F.col("rating") - 3.6) * 0.5, F.lit(0.0)) + F.when(fits, 0.25).otherwise(0.0) + F.when(F.col("writer").isNull() & F.coalesce("mine", F.lit(False)) & (F.col("akey") != ""), 0.3).otherwise(0.0)
    )
    why = F.concat(F.coalesce("why", F.array().cast("array<string>")), F.filter(F.array(F.when(F.col("writer").isNotNull(), F.concat(F.lit("by "), "writer")), F.when(F.col("full_text"), "free full text"), F.when(fits, "about the length you tend to finish")), lambda x: x.isNotNull()))
    out = hit.select("id", "title", "author", js_round(F.round(score, 9), 2).alias("score"), F.slice(F.array_distinct(why), 1, 3).alias("reasons"))
    return out.orderBy(F.col("score").desc(), "id").limit(limit)


def enrich(books: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """Fills what a book lacks from the first match; books from photos, and complete ones, stay as they are."""
    first = found.withColumn("_rank", F.row_number().over(Window.partitionBy("book_id").orderBy("rank"))).filter("_rank = 1").select("book_id", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = books.join(first, "book_id", "left")
    return joined.select(*[c for c in books.columns if c not in columns], *[F.when(F.col("source") == "photo", F.col(c)).otherwise(F.coalesce(c, f"_{c}")).alias(c) for c in columns])
