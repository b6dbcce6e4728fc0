"""Readability of books from a strided sample of paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LONG, SOUNDS, count_words, js_round, sentence_pieces, syllable_marks

READABILITY = ["words", "sentences", "flesch", "grade", "words_per_sentence", "syllables_per_word", "dialogue_share", "long_word_share", "band"]
#: Paragraphs that the stride aims at, and words after which no further paragraph is taken.
SAMPLE_PARAGRAPHS, SAMPLE_WORDS = 150, 5000


def sampled(paras: DataFrame) -> DataFrame:
    """Every n-th paragraph of a book until the ones before hold SAMPLE_WORDS words."""
    w = Window.partitionBy("doc_id")
    k = F.row_number().over(w.orderBy("c", "p")) - 1
    rows = paras.withColumn("k", k).withColumn("step", F.greatest(F.lit(1), F.floor(F.count("*").over(w) / SAMPLE_PARAGRAPHS))).filter("k % step = 0")
    seen = F.coalesce(F.sum("pwc").over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("seen", seen).filter(F.col("seen") < SAMPLE_WORDS).select("doc_id", "c", "p", "text", "pwc")


def readability(paras: DataFrame) -> DataFrame:
    """One row per book with words. Words are counted inside each sentence's row, so one shuffle by book is all there is."""
    pieces = sampled(paras).select("doc_id", F.explode(sentence_pieces(F.col("text"))).alias("text"))
    rows = pieces.select("doc_id", "text", count_words(F.col("text")).alias("n_words"), syllable_marks(F.col("text")).alias("marks"))
    sums = rows.groupBy("doc_id").agg(
        F.sum("n_words").alias("words"), F.count("*").alias("sentences"), F.sum(F.regexp_count("marks", F.lit(SOUNDS))).alias("syll"),
        F.sum(F.regexp_count("marks", F.lit(LONG))).alias("long_words"), F.count_if(F.col("text").rlike("[\"“”]")).alias("dialogue"),
    )
    wps, spw = F.col("words") / F.col("sentences"), F.col("syll") / F.col("words")
    flesch, grade = 206.835 - 1.015 * wps - 84.6 * spw, 0.39 * wps + 11.8 * spw - 15.59
    return sums.filter("words > 0").select(
        "doc_id", "words", "sentences", js_round(flesch).alias("flesch"), js_round(F.greatest(F.lit(0.0), grade), 1).alias("grade"), js_round(wps, 1).alias("words_per_sentence"), js_round(spw, 2).alias("syllables_per_word"),
        js_round(F.col("dialogue") / F.col("sentences"), 3).alias("dialogue_share"), js_round(F.col("long_words") / F.col("words"), 3).alias("long_word_share"),
        F.when(flesch >= 70, "Light").when(flesch >= 50, "Moderate").otherwise("Dense").alias("band"),
    )
