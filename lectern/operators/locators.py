"""Canonical positions: chapter, paragraph, sentence, word; and the global word offset they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.asof import asof_join
from ..plans.corpus import offsets, sentences


def sentence_offsets(paras: DataFrame) -> DataFrame:
    """(doc_id, c, p, s, n_words, word_start, g, total): g is the global offset of the sentence's first word."""
    flat = sentences(paras).select("doc_id", "c", "p", "s", "n_words", "word_start").join(offsets(paras).select("doc_id", "c", "p", F.col("g").alias("pg"), "total"), ["doc_id", "c", "p"])
    return flat.select("doc_id", "c", "p", "s", "n_words", "word_start", (F.col("pg") + F.col("word_start")).alias("g"), "total")


def loc_to_global(locs: DataFrame, placed: DataFrame) -> DataFrame:
    """locs (doc_id, c, p, s, w) with g; w is clamped to the sentence, a position that is not in the book is its end."""
    ends = placed.groupBy("doc_id").agg(F.first("total").alias("end"))
    found = locs.join(placed.select("doc_id", "c", "p", "s", "n_words", F.col("g").alias("sg")), ["doc_id", "c", "p", "s"], "left").join(ends, "doc_id", "left")
    w = F.greatest(F.lit(0), F.least("w", F.col("n_words") - 1))
    return found.select(*locs.columns, F.coalesce(F.col("sg") + w, "end").alias("g"))


def global_to_loc(points: DataFrame, placed: DataFrame) -> DataFrame:
    """points (doc_id, q) with c, p, s, w; q is clamped to the book."""
    ends = placed.groupBy("doc_id").agg(F.first("total").alias("end"))
    clamped = points.join(ends, "doc_id").withColumn("g", F.greatest(F.lit(0), F.least("q", F.col("end") - 1))).select("doc_id", "q", "g")
    found = asof_join(clamped, placed.filter("n_words > 0").select("doc_id", F.col("g").alias("sg"), "c", "p", "s"), ["doc_id"], "g", "sg")
    return found.select("doc_id", "q", "c", "p", "s", (F.col("g") - F.col("sg")).alias("w"))


def key(c, p, s):
    return F.when(F.col(c).isNotNull(), F.concat_ws(".", c, p, s))


def walk(placed: DataFrame) -> DataFrame:
    """Each sentence with the keys of the ones before and after it, across paragraphs and chapters."""
    w = Window.partitionBy("doc_id").orderBy("c", "p", "s")
    here = F.concat_ws(".", "c", "p", "s")
    return placed.filter("n_words > 0").select("doc_id", here.alias("loc"), F.lag(here).over(w).alias("prev_loc"), F.lead(here).over(w).alias("next_loc"))
