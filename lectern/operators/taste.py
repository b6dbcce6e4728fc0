"""Facts about one book, and the taste that a shelf shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_round, normalize

DONE, STARTED, STARTED_MINUTES = 0.98, 0.02, 2
LIBRARY_WORDS, DEFAULT_WPM = 90_000, 230


def weight(percent: Column, done: Column, minutes: Column) -> Column:
    return 0.25 + 0.75 * percent + F.when(done, 0.6).otherwise(0.0) + F.least(F.lit(1.0), minutes / 120) * 0.6


def taste(named: DataFrame, top: int, scaled: bool) -> DataFrame:
    """(key, name, weight, books, ord) of the heaviest keys, of equals those with the smallest ord. named: name, w, ord; the spelling with the
    smallest ord is shown."""
    keyed = named.withColumn("key", normalize(F.col("name"))).filter("key != ''")
    sums = keyed.groupBy("key").agg(F.min_by(F.trim("name"), "ord").alias("name"), F.round(F.sum("w"), 6).alias("weight"), F.count("*").alias("books"), F.min("ord").alias("ord"))
    best = sums.orderBy(F.col("weight").desc(), "ord").limit(top)
    if not scaled:
        return best
    return best.withColumn("weight", js_round(F.col("weight") / F.max("weight").over(Window.partitionBy(F.lit(1))), 2))


def first_author(author: Column) -> Column:
    return F.split(author, ",|&| and ")[0]


def archetype(subjects: Column, listen_share: Column, finished: Column, started: Column, minutes: Column) -> Column:
    """subjects: normalised names of the top subjects, joined with spaces."""
    rules = (
        ("fantasy|science fiction|adventure", "World-builder"), ("mystery|detective|crime|thriller", "Puzzle-solver"), ("history|biography|science|philosophy|essays|politics", "Deep-diver"),
        ("romance|love|domestic", "Heart-first reader"), ("poetry|drama|plays", "Language-lover"), ("children|fairy|juvenile|nonsense", "Wonder-seeker"),
    )
    base = F.lit("Wide-ranging reader")
    for pattern, name in reversed(rules):
        base = F.when(subjects.rlike(pattern), name).otherwise(base)
    suffix = F.when(listen_share > 0.6, ", mostly by ear").when((finished >= 3) & (started > 0) & (finished / started > 0.7), ", a finisher").otherwise("")
    return F.when(minutes < 5, "Just getting started").otherwise(F.concat(base, suffix))


def length_band(words: Column) -> Column:
    bands = F.when(words < 25_000, "Novella-length").when(words < 60_000, "Short novel").when(words < 110_000, "Full-length novel")
    return bands.when(words < 200_000, "Long read").otherwise("Epic")


def label(books: DataFrame) -> DataFrame:
    """The reading label. books: book_id, words, chapters, wpm, library_wpm, median_words, minutes, listen_minutes, percent, finished."""
    wpm = F.coalesce("wpm", "library_wpm", F.lit(DEFAULT_WPM))
    mine, usual = F.col("wpm"), F.col("library_wpm")
    compare = F.when(mine.isNotNull() & usual.isNotNull(), F.when(mine > usual * 1.1, "faster than your usual").when(mine < usual * 0.9, "slower than your usual").otherwise("your usual pace"))
    return books.select(
        "book_id", "words", js_round(F.col("words") / wpm / 60, 3).alias("hours"), js_round(F.col("words") / F.greatest(F.lit(1), F.col("chapters"))).alias("avg_chapter_words"), length_band(F.col("words")).alias("length_band"),
        js_round(F.col("words") / F.coalesce(F.nullif("median_words", F.lit(0)), F.lit(LIBRARY_WORDS)), 3).alias("length_ratio"), compare.alias("pace"),
        js_round(F.when(F.col("minutes") > 0, F.col("listen_minutes") / F.col("minutes")).otherwise(0.0), 3).alias("listen_share"), (F.col("finished") | (F.col("percent") >= DONE)).alias("finished"),
    )
