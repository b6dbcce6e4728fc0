"""Where a noisy passage comes from: a shingle index, weighted votes, and the diagonal of the match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_words, sentence_pieces, words
from ..plans.ranks import upper_median_by_counts
from ..plans.shared import kept

WIDTH, CAP, BAND, DIAGONAL, EXTEND = 4, 64, 8, 15, 2


def shingles(tokens: str):
    """All runs of WIDTH tokens; none for shorter lists."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.concat_ws(" ", F.slice(tokens, i + 1, F.lit(WIDTH))))
    return F.when(n >= WIDTH, runs).otherwise(F.array().cast("array<string>"))


def postings(paras: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, c, p, i, n): at most CAP postings of a key and book in reading order; n is how many there are.

    only: keys to look for (column key). They are joined before postings are ranked, so a query touches no more than its own keys. Without it
    paragraphs go to their book first: what is ranked in a book is never exchanged, which is many times its text.
    """
    if only is None:
        paras = paras.repartition("doc_id")
    at = paras.select("doc_id", "c", "p", norm_words(F.col("text")).alias("t")).select("doc_id", "c", "p", F.posexplode(shingles("t")).alias("i", "key"))
    if only is not None:
        at = at.join(only, "key", "left_semi")
    w = Window.partitionBy("doc_id", "key")
    ranked = at.withColumn("rank", F.row_number().over(w.orderBy("c", "p", "i"))).filter(F.col("rank") <= CAP)
    return ranked.withColumn("n", F.count("*").over(w)).select("doc_id", "key", "c", "p", "i", "n")


def hits(paras: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Query shingles found in books, and queries (item_id, n_tokens, n_shingles). queries: item_id, text."""
    tokens = queries.select("item_id", norm_words(F.col("text")).alias("t")).withColumn("n_tokens", F.size("t")).filter(F.col("n_tokens") >= WIDTH + 2)
    keys = tokens.select("item_id", "n_tokens", F.posexplode(shingles("t")).alias("qi", "key"))
    found = keys.join(postings(paras, keys.select("key").distinct()), "key")
    return found.select("item_id", "doc_id", "qi", "c", "p", F.col("i").alias("nw"), "n"), tokens.select("item_id", "n_tokens", (F.col("n_tokens") - WIDTH + 1).alias("n_shingles"))


def votes(found: DataFrame) -> DataFrame:
    return found.groupBy("item_id", "doc_id", "c", "p").agg(F.round(F.sum(1 / F.sqrt("n")), 9).alias("votes"), F.min(F.struct("qi", "c", "p", "nw")).alias("seen"))


def match(paras: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query and book with a match: winner's chapter, confidence, and start and end as (paragraph, normalised word).

    Ties between paragraphs go to the one met first (in query order, then reading order).
    """
    found, sizes = hits(paras, queries)
    found = kept(found, "hits")  # read five times below
    w = Window.partitionBy("item_id", "doc_id").orderBy(F.col("votes").desc(), "seen")
    best = votes(found).withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("item_id", "doc_id", "c", F.col("p").alias("bp"))
    lens = paras.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "c", "p", F.size(norm_words(F.col("text"))).alias("len"))
    before = Window.partitionBy("doc_id", "c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    lens = lens.withColumn("off", F.coalesce(F.sum("len").over(before), F.lit(0)))
    near = found.join(best, ["item_id", "doc_id", "c"]).filter(F.abs(F.col("p") - F.col("bp")) <= BAND).join(lens, ["doc_id", "c", "p"])
    near = near.withColumn("diag", F.col("off") + F.col("nw") - F.col("qi"))
    middle = upper_median_by_counts(near, ["item_id", "doc_id"], "diag").withColumnRenamed("median", "med")
    good = near.join(middle, ["item_id", "doc_id"]).filter(F.abs(F.col("diag") - F.col("med")) <= DIAGONAL)
    out = good.groupBy("item_id", "doc_id", "c").agg(F.count_distinct("qi").alias("matched"), F.min(F.struct("qi", "p", "nw", "len")).alias("a"), F.max(F.struct("qi", "p", "nw", "len")).alias("b")).join(sizes, "item_id")
    lead, tail = F.least(F.lit(EXTEND), "a.qi"), F.least(F.lit(EXTEND), F.greatest(F.lit(0), F.col("n_tokens") - (F.col("b.qi") + WIDTH)))
    return out.select(
        "item_id", "doc_id", "c", "matched", F.col("n_shingles").alias("total"), F.least(F.lit(1.0), F.col("matched") / F.col("n_shingles")).alias("confidence"),
        F.col("a.p").alias("start_p"), F.greatest(F.lit(0), F.col("a.nw") - lead).alias("start_nw"), F.col("b.p").alias("end_p"), F.least(F.greatest(F.lit(0), F.col("b.len") - 1), F.col("b.nw") + WIDTH - 1 + tail).alias("end_nw"),
    )


def to_locator(points: DataFrame, paras: DataFrame) -> DataFrame:
    """points (…, doc_id, c, p, nw) with s, w and the 14 words that start there. Words without a token are passed over."""
    texts = paras.join(points.select("doc_id", "c", "p").distinct(), ["doc_id", "c", "p"], "left_semi")
    flat = texts.select("doc_id", "c", "p", F.posexplode(sentence_pieces(F.col("text"))).alias("s", "t"), words(F.col("text")).alias("all")).select("doc_id", "c", "p", "s", "all", F.posexplode(words(F.col("t"))).alias("w", "word"))
    run = Window.partitionBy("doc_id", "c", "p").orderBy("s", "w").rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.withColumn("k", F.size(norm_words(F.col("word")))).withColumn("from", F.coalesce(F.sum("k").over(run), F.lit(0))).withColumn("nth", F.count("*").over(run))
    found = points.join(flat, ["doc_id", "c", "p"]).filter("nw >= `from` and nw < `from` + k")
    some = F.slice("all", (F.col("nth") + 1).cast("int"), 14)
    snippet = F.concat(F.array_join(some, " "), F.when(F.size(some) >= 14, "…").otherwise(""))
    return found.select(*points.columns, "s", "w", snippet.alias("snippet"))
