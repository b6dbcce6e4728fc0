"""Blocks, titles and chapters of marked-up text, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_words

#: Tags whose content is never text, tags that break a block, and entities that pages use.
DROPPED = ("script", "style", "noscript", "svg", "math", "template", "iframe", "object")
BLOCKS = (
    "p div section article blockquote li ul ol dl dd dt pre table tbody thead tr td th figure figcaption header footer main aside hr address center body nav details summary"
).split()
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))
#: Marks that stand for block ends, headings and line breaks while tags are taken out.
END, HEAD, BREAK = "\u0001", "\u0002", "\u0003"

SPACE = r"[\s ]+"


def decode(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, i, level, text): level 0 for text, 1 to 6 for headings. Blocks without a letter or digit are left out."""
    h = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<!--.*?-->|<head\b.*?</head\s*>", "")
    for tag in DROPPED:
        h = F.regexp_replace(h, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    h = F.regexp_replace(h, r"(?i)<br\b[^>]*>", BREAK)
    h = F.regexp_replace(h, r"(?i)<h([1-6])\b[^>]*>", f"{END}{HEAD}$1")
    h = F.regexp_replace(h, rf"(?i)</?(?:h[1-6]|{'|'.join(BLOCKS)})\b[^>]*>", END)
    h = F.regexp_replace(decode(F.regexp_replace(h, "<[^>]*>", "")), SPACE, " ")
    raw = pages.select("page_id", F.posexplode(F.split(h, END)).alias("i", "t"))
    level = F.when(F.col("t").startswith(HEAD), F.substring("t", 2, 1).cast("int")).otherwise(0)
    body = F.when(F.col("t").startswith(HEAD), F.replace(F.expr("substring(t, 3)"), F.lit(BREAK), F.lit(""))).otherwise(F.replace("t", F.lit(BREAK), F.lit("\n")))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"[ \t]*\n[ \t]*", "\n"), " {2,}", " "), r"\n{2,}", "\n")
    return raw.select("page_id", "i", level.alias("level"), F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "").alias("text")).filter(F.col("text").rlike(r"[\p{L}\p{N}]"))


def title_lang(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    title = F.trim(F.regexp_replace(decode(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)), SPACE, " "))
    author = F.regexp_extract(html, r"(?i)<meta\s+name=[\"']author[\"']\s+content=[\"']([^\"']*)", 1)
    return pages.select("page_id", title.alias("title"), author.alias("author"), F.substring(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang=[\"']([^\"']*)", 1), 1, 5).alias("language"))


def chapters(blocks: DataFrame, by: str, fallback: Column | None = None) -> DataFrame:
    """(by, idx, title, paragraphs, words) from blocks (by, i, heading, text).

    A heading starts a chapter; headings without text of their own are carried into the next chapter's title. Chapters without a title
    are numbered, the first one takes the fallback. Everything is a window over one document, so one shuffle.
    """
    w = Window.partitionBy(by).orderBy("i")
    rows = blocks.withColumn("isl", F.sum(F.col("heading").cast("int")).over(w))
    w_isl = Window.partitionBy(by).orderBy("isl")
    chs = rows.groupBy(by, "isl").agg(F.max(F.when(F.col("heading"), F.col("text"))).alias("title"), F.count_if(~F.col("heading")).alias("n"), F.sum(F.when(~F.col("heading"), count_words(F.col("text")))).alias("w"))
    run = chs.withColumn("k", F.coalesce(F.sum((F.col("n") > 0).cast("int")).over(w_isl.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = run.groupBy(by, "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("title").isNotNull(), F.struct("isl", "title")))), lambda t: t["title"]), " · ").alias("title"), F.sum("n").alias("paragraphs"), F.sum("w").cast("long").alias("words"))
    out = out.filter("paragraphs > 0")
    first = F.lit("Section 1") if fallback is None else fallback
    named = F.when(F.col("title") != "", F.col("title")).when(F.col("k") == 0, first).otherwise(F.concat(F.lit("Section "), F.col("k") + 1))
    return out.select(by, F.col("k").alias("idx"), named.alias("title"), "paragraphs", "words")


#: Words that open a chapter heading.
HEADING_WORDS = "chapter book part canto letter section act scene stave prologue epilogue introduction preface foreword afterword appendix contents dedication volume conclusion postscript".split()
HEADING = rf"(?i)^(?:{'|'.join(HEADING_WORDS)})(?![A-Za-z0-9_])"
ROMAN, NUMBER = r"^[IVXLC]+\.?$", r"^[0-9]{1,3}\.?$"


def classify(lines: Column) -> Column:
    """The kind of a block of trimmed, visible lines: illustration, toc, heading, verse or para."""
    joined = F.trim(F.regexp_replace(F.array_join(lines, " "), r"\s+", " "))
    n, first = F.size(lines), F.element_at(lines, 1)
    toc = F.size(F.filter(lines, lambda x: x.rlike(HEADING) | x.rlike(r"^[IVXLC]+\.?\s") | x.rlike(r"^[0-9]{1,3}\.?\s"))) / n
    letters = F.regexp_replace(joined, "[^A-Za-z]", "")
    caps = (F.length(letters) >= 3) & (letters == F.upper(letters)) & ~joined.rlike("[.!?]$")
    short = F.size(F.filter(lines, lambda x: F.length(x) < 55)) / n
    mean = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) / n
    return (
        F.when(joined.rlike(r"(?i)^\[illustration") & joined.rlike(r"\]$"), "illustration")
        .when((n >= 3) & (toc >= 0.6), "toc")
        .when((n <= 3) & (F.length(joined) <= 90) & (count_words(joined) <= 12) & (first.rlike(HEADING) | first.rlike(ROMAN) | first.rlike(NUMBER) | caps), "heading")
        .when((n >= 2) & (short >= 0.75) & (mean < 46), "verse")
        .otherwise("para")
    )


def between_markers(paras: DataFrame, start: str, end: str) -> DataFrame:
    """paras (doc_id, c, p, text) of what lies between licence markers; books without a marker stay whole.

    The first end marker closes the text, and the last start marker before it opens it.
    """
    pos = F.struct("c", "p")
    w = Window.partitionBy("doc_id")
    rows = paras.withColumn("pos", pos).withColumn("s", F.col("text").rlike(start)).withColumn("e", F.col("text").rlike(end))
    rows = rows.withColumn("stop", F.min(F.when(F.col("e"), F.col("pos"))).over(w))
    rows = rows.withColumn("open", F.max(F.when(F.col("s") & (F.col("stop").isNull() | (F.col("pos") < F.col("stop"))), F.col("pos"))).over(w))
    return rows.filter((F.col("open").isNull() | (F.col("pos") > F.col("open"))) & (F.col("stop").isNull() | (F.col("pos") < F.col("stop")))).select("doc_id", "c", "p", "text")


def heading_runs(items: DataFrame) -> DataFrame:
    """items (doc_id, i, kind) where runs of four headings or more have become toc."""
    w = Window.partitionBy("doc_id").orderBy("i")
    isl = F.sum(F.when(F.lag("kind").over(w) == F.col("kind"), 0).otherwise(1)).over(w)
    rows = items.withColumn("isl", isl).withColumn("run", F.count("*").over(Window.partitionBy("doc_id", "isl")))
    return rows.withColumn("kind", F.when((F.col("kind") == "heading") & (F.col("run") >= 4), "toc").otherwise(F.col("kind"))).select("doc_id", "i", "kind")
