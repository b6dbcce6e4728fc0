"""Documents as books: chapters of 20 paragraphs, a paragraph being a line with visible text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_words, sentence_pieces

CHAPTER = 20


def visible_lines(text: Column) -> Column:
    """The paragraphs of a document, in order."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")), lambda x: x != "")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, c, p, text, pwc). No shuffle: a document's lines are numbered inside its own row."""
    at = docs.select("doc_id", F.posexplode(visible_lines(F.col("text"))).alias("k", "text"))
    return at.select("doc_id", F.floor(F.col("k") / CHAPTER).cast("int").alias("c"), (F.col("k") % CHAPTER).cast("int").alias("p"), "text", count_words(F.col("text")).cast("int").alias("pwc"))


#: Entries that running() sums in one go.
RUN = 64


def running(values: Column) -> Column:
    """For each entry of an array of integers the sum of those before it: sums of runs first, then inside an entry's run, so that the work
    grows little faster than the array."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, v: a + v)
    once = lambda x, use: F.get(F.transform(F.array(x), use), F.lit(0))

    def of(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / RUN).cast("int")
        runs = F.transform(F.sequence(F.lit(0), last), lambda k: total(F.slice(v, k * RUN + 1, F.lit(RUN))))
        heads = once(runs, lambda c: F.transform(c, lambda _, k: total(F.slice(c, F.lit(1), k))))
        return once(heads, lambda h: F.transform(v, lambda _, i: F.get(h, F.floor(i / RUN).cast("int")) + total(F.slice(v, i - i % RUN + 1, i % RUN))))

    return F.when(F.size(values) > 0, once(values, of)).otherwise(F.array().cast("array<int>"))


def sentences(paras: DataFrame) -> DataFrame:
    """(doc_id, c, p, s, start, text, n_words, word_start). No shuffle: each sentence's row adds up what stands before it in its paragraph.

    In paragraphs of up to RUN sentences it does so from the paragraph's short list, which costs less than a list of sums; longer ones have their
    sums worked out once, so a line of many sentences costs no more a sentence than a short one.
    """
    pieces = paras.select("doc_id", "c", "p", sentence_pieces(F.col("text")).alias("x"))
    sized = pieces.select("doc_id", "c", "p", "x", F.transform("x", F.length).alias("chars"), F.transform("x", count_words).alias("words"))
    few = F.size("x") <= RUN
    short = [F.when(few, F.col(c)).alias(f"few_{c}") for c in ("chars", "words")]
    sums = [F.when(few, F.col(c)).otherwise(running(F.col(c))).alias(f"upto_{c}") for c in ("chars", "words")]
    both = sized.select("doc_id", "c", "p", *short, F.arrays_zip("x", "words", *sums).alias("z"))
    rows = both.select("doc_id", "c", "p", "few_chars", "few_words", F.posexplode("z").alias("s", "z"))
    before = lambda c: F.when(F.col(f"few_{c}").isNull(), F.col(f"z.upto_{c}")).otherwise(F.aggregate(F.slice(f"few_{c}", F.lit(1), F.col("s")), F.lit(0), lambda a, v: a + v))
    return rows.select("doc_id", "c", "p", "s", before("chars").alias("start"), F.rtrim("z.x").alias("text"), F.col("z.words").alias("n_words"), before("words").alias("word_start"))


def offsets(paras: DataFrame) -> DataFrame:
    """paras without text, with g (words before the paragraph) and total (words of the book). One shuffle, by book."""
    w = Window.partitionBy("doc_id")
    before = w.orderBy("c", "p").rowsBetween(Window.unboundedPreceding, -1)
    return paras.select("doc_id", "c", "p", "pwc", F.coalesce(F.sum("pwc").over(before), F.lit(0)).alias("g"), F.sum("pwc").over(w).alias("total"))
