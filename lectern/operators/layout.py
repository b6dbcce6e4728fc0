"""Documents of fixed pages: text items to lines, paragraphs and chapters. Every step is a window or a grouping by document and page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_words, normalize
from ..plans.asof import asof_join
from ..plans.ranks import upper_median_by_counts
from ..plans.shared import kept

#: Fixed values of lines: the least step in y and its share of the smaller height that part two lines; the gap, in heights, that is a blank.
LINE_STEP, LINE_SHARE, BLANK = 2.0, 0.6, 0.12
#: Fixed values of running heads: lines at either end of a page, and the pages on which one must stand.
EDGE, LEAST_PAGES, PAGE_SHARE = 2, 3, 0.3
#: Fixed values of paragraphs, in heights of the body: a heading's height, a parting gap, an indent; words of a heading and of a sentence that
#: ends in a full stop and is none; the share of the widest line below which a line is short.
HEADING, GAP, INDENT, HEADING_WORDS, SENTENCE_WORDS, SHORT = 1.22, 1.7, 0.9, 14, 8, 0.75
#: Fixed values of chapters: pages up to which a document is one, pages of a chapter beyond, entries of an outline and headings that are enough,
#: headings a page that are too many.
ONE_CHAPTER, PAGES_EACH, ENTRIES, HEADS, MOST_HEADS, HEADS_A_PAGE = 40, 20, 2, 2, 6, 1.5
#: Characters of a page below which recognised text stands in for it.
BARE = 40
FRONT, JOINT = "Front matter", " · "

ITEMS = "doc_id, page, str, x, y, h, w"
_PAGE = ["doc_id", "page"]


def _ordered(by: list[str], *order: Column | str) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def _before(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def items_to_lines(items: DataFrame) -> DataFrame:
    """(doc_id, page, line, text, x, x_end, y, h) from text items (doc_id, page, str, x, y, h, w); y grows upwards.

    Items from top to bottom, and from left to right where they are level, make one line as long as y falls by less than LINE_STEP, or
    LINE_SHARE of the smaller height, from one to the next. What begins more than BLANK heights behind the line's end so far is set
    off by a blank. A line has its first item's place and its highest item's height. Blank items make nothing.
    """
    order = [F.desc("y"), F.asc("x"), F.asc("str"), F.asc("w")]
    rows = items.filter(F.col("str").rlike(r"(?U)\S")).withColumn("right", F.col("x") + F.col("w"))
    along = _ordered(_PAGE, *order)
    step = F.lag("y").over(along) - F.col("y")
    parted = step >= F.greatest(F.lit(LINE_STEP), LINE_SHARE * F.least(F.lag("h").over(along), F.col("h")))
    rows = rows.withColumn("line", F.sum(F.when(parted, 1).otherwise(0)).over(along))
    # What stands before in the line, in the order of the page: the greatest of (line, value) so far is of the row's own line or of an earlier one.
    upto = lambda c: F.max(F.struct("line", c)).over(_before(along))
    rows = rows.withColumns({"nth": F.row_number().over(along), "end": upto("right"), "high": upto("h"), "last": F.lag("str").over(along)})
    blank = (F.col("end.line") == F.col("line")) & (F.col("x") - F.col("end.right") > BLANK * F.col("high.h")) & ~F.col("last").endswith(" ") & ~F.col("str").startswith(" ")
    rows = rows.withColumn("piece", F.concat(F.when(blank, " ").otherwise(""), "str"))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("nth", "piece"))), lambda p: p["piece"])
    text = F.trim(F.regexp_replace(F.array_join(pieces, ""), r"(?U)\s+", " "))
    first = F.min(F.struct("nth", "x", "y"))
    lines = rows.groupBy(*_PAGE, "line").agg(text.alias("text"), first.alias("first"), F.max("right").alias("x_end"), F.max("h").alias("h"))
    return lines.select(*_PAGE, F.col("line").cast("int").alias("line"), "text", F.col("first.x").alias("x"), "x_end", F.col("first.y").alias("y"), "h")


def line_key(text: Column) -> Column:
    """Lower case, digit runs as #, letters only: running heads differ in nothing else."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "#"), r"[^\p{L}#]", "")


def edges(lines: DataFrame) -> DataFrame:
    """The first and last two lines of each page. lines: doc_id, page, line, text."""
    n = F.count("*").over(Window.partitionBy("doc_id", "page"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line"))
    return lines.withColumn("n", n).withColumn("nth", nth).filter((F.col("nth") <= EDGE) | (F.col("nth") > F.col("n") - EDGE))


def _paged(lines: DataFrame) -> DataFrame:
    """(doc_id, pages) of documents with enough pages for running heads."""
    return lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)


def _repeated(keyed: DataFrame, paged: DataFrame) -> DataFrame:
    counted = keyed.select("doc_id", "page", "key").filter(F.length("key") >= 2).distinct().groupBy("doc_id", "key").agg(F.count("*").alias("on_pages")).join(paged, "doc_id")
    return counted.filter(F.col("on_pages") >= F.greatest(F.lit(LEAST_PAGES), F.ceil(PAGE_SHARE * F.col("pages")))).select("doc_id", "key", "on_pages")


def furniture(lines: DataFrame) -> DataFrame:
    """(doc_id, key, on_pages): edge lines, by keys of two letters or more, on at least 3 pages and 30% of them, in documents of 3 pages or more."""
    return _repeated(edges(lines).withColumn("key", line_key(F.col("text"))), _paged(lines))


def strip_furniture(lines: DataFrame) -> DataFrame:
    """lines without running heads and without page numbers (arabic or roman) at the edges of pages, in documents of 3 pages or more.

    Lines are kept, and so are the keys of their edges, which tell all the rest: every page with lines has edges.
    """
    lines = kept(lines, "lines")
    number = F.regexp_replace("text", r"\s", "").rlike("(?i)^[0-9ivxlc]{1,6}$")
    at_edge = kept(edges(lines).select("doc_id", "page", "line", line_key(F.col("text")).alias("key"), number.alias("number")), "edges")
    paged = _paged(at_edge)
    gone = at_edge.join(paged.select("doc_id"), "doc_id", "left_semi").join(_repeated(at_edge, paged), ["doc_id", "key"], "left").filter(F.col("on_pages").isNotNull() | F.col("number"))
    gone = gone.groupBy(*_PAGE).agg(F.collect_set("line").alias("gone"))  # four lines a page at most
    return lines.join(gone.hint("shuffle_hash"), _PAGE, "left").filter(F.col("gone").isNull() | ~F.array_contains("gone", F.col("line"))).select(*lines.columns)


def body_height(lines: DataFrame) -> DataFrame:
    return upper_median_by_counts(lines, "doc_id", "h").withColumnRenamed("median", "body")


def _rejoined(text: Column) -> Column:
    """Lines with breaks between them as one: a hyphen after a letter and before a small one goes with its break."""
    return F.regexp_replace(F.regexp_replace(text, r"(?<=[A-Za-z])-\n(?=[a-z])", ""), "\n", " ")


def lines_to_paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, page, block, text, heading) from lines (doc_id, page, line, text, x, x_end, y, h).

    A line is a heading if it is high, short, ends in none of , ; : and is no sentence of over 8 words; each is a block. Others go on with the
    paragraph before unless a wide gap parts them, an indent follows a line without one, or the line before is short and ends as a
    sentence does. Heights are the document's usual one, widths the page's widest line.
    """
    along = _ordered(_PAGE, "line")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lines = kept(lines, "body")
    words = count_words(F.col("text"))
    heading = (F.col("h") > HEADING * F.col("body")) & (words <= HEADING_WORDS) & ~F.col("text").rlike("[,;:]$") & ~(F.col("text").rlike(r"[a-z]\.$") & (words > SENTENCE_WORDS))
    rows = lines.join(body_height(lines).hint("shuffle_hash"), "doc_id").withColumns({"heading": heading, "width": F.col("x_end") - F.col("x"), "inset": F.col("x") - F.min("x").over(whole)})
    rows = rows.withColumn("widest", F.max("width").over(whole))
    prev = lambda c: F.lag(c).over(along)
    gap = prev("y") - F.col("y") > GAP * F.col("body")
    indent = (F.col("inset") > INDENT * F.col("body")) & (prev("inset") < INDENT * F.col("body"))
    short = (prev("width") < SHORT * F.col("widest")) & prev("text").rlike(r"[.!?…\"”’')\]]$")
    new = prev("line").isNull() | F.col("heading") | prev("heading") | gap | indent | short
    rows = rows.withColumn("block", F.sum(new.cast("int")).over(along))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda t: t["text"]), "\n")
    return rows.groupBy(*_PAGE, "block").agg(_rejoined(joined).alias("text"), F.first("heading").alias("heading"))


def with_recognised(blocks: DataFrame, lines: DataFrame, recognised: DataFrame) -> DataFrame:
    """blocks with recognised paragraphs (doc_id, page, block, text) in place of those of pages whose lines have under 40 characters."""
    full = lines.groupBy(*_PAGE).agg(F.sum(F.length("text")).alias("chars")).filter(F.col("chars") >= BARE).select(*_PAGE)
    instead = recognised.join(full, _PAGE, "left_anti").select(*_PAGE, F.col("block").cast("long").alias("block"), "text", F.lit(False).alias("heading"))
    return blocks.join(instead.select(*_PAGE).distinct(), _PAGE, "left_anti").select(instead.columns).unionByName(instead)


def merge_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, page, text, heading): a paragraph that a page break cuts is one again and keeps its first page.

    It goes on if it does not end as a sentence and the next page begins with a small letter, a quote or a bracket. What has been joined has its
    first page, so it is not joined with the page after next: of blocks that all go on, every second one joins the one before.
    """
    w = _ordered(["doc_id"], "page", "block")
    carries = ~F.col("heading") & ~F.lag("heading").over(w) & ~F.lag("text").over(w).rlike(r"[.!?…\"”’')\]:]$") & F.col("text").rlike(r"^[a-z(“\"‘']") & (F.col("page") == F.lag("page").over(w) + 1)
    rows = blocks.withColumn("carries", F.coalesce(carries, F.lit(False)))
    # A part begins where a paragraph does not go on, and at every second one of those that do.
    rows = rows.withColumn("nth", F.row_number().over(w))
    rows = rows.withColumn("place", F.col("nth") - F.max(F.when(~F.col("carries"), F.col("nth"))).over(w))
    rows = rows.withColumn("ord", F.sum((F.col("place") % 2 == 0).cast("int")).over(w).cast("int"))
    parts = rows.groupBy("doc_id", "ord").agg(F.min("page").alias("page"), F.sort_array(F.collect_list(F.struct("page", "block", "text"))).alias("parts"), F.first("heading").alias("heading"))
    text = F.when(F.size("parts") == 1, _rejoined(F.col("parts")[0]["text"])).otherwise(_rejoined(F.array_join(F.transform("parts", lambda t: t["text"]), "\n")))
    return parts.select("doc_id", "ord", "page", text.alias("text"), "heading")


def flat_outline(outlines: DataFrame) -> DataFrame:
    """(doc_id, page, title) of outlines (doc_id, items): the entries of two levels in their order, the first that has a title of each page.

    items: array of (title, page, items), of which the inner ones have title and page. An entry without a page still has its children's.
    """
    blank = lambda t: F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " "))
    top = outlines.select("doc_id", F.posexplode("items").alias("i", "it"))
    own = F.array(F.struct(F.lit(-1).alias("j"), F.col("it.title").alias("title"), F.col("it.page").alias("page")))
    below = F.coalesce(F.transform("it.items", lambda c, j: F.struct(j.alias("j"), c["title"].alias("title"), c["page"].alias("page"))), F.array().cast("array<struct<j:int,title:string,page:int>>"))
    every = top.select("doc_id", "i", F.inline(F.concat(own, below))).select("doc_id", "i", "j", "page", blank(F.col("title")).alias("title"))
    kept = every.filter(F.col("page").isNotNull() & (F.col("title") != ""))
    return kept.groupBy("doc_id", "page").agg(F.min_by("title", F.struct("i", "j")).alias("title"))


_CHAPTERED = ["doc_id", "start", "ord", "page", "title", "text"]


def by_outline(blocks: DataFrame, outline: DataFrame) -> DataFrame:
    """blocks (doc_id, ord, page, text, heading) with the start and title of the last entry at or before their page; what stands before the
    first is front matter. Headings that repeat the title go, and at a chapter's head those that are part of it."""
    entries = outline.select("doc_id", F.col("page").alias("start"), "title")
    rows = asof_join(blocks, entries.withColumn("at", F.col("start")), ["doc_id"], "page", "at").drop("at")
    rows = rows.withColumns({"start": F.coalesce("start", F.lit(0)), "title": F.coalesce("title", F.lit(FRONT))})
    own, name = normalize(F.col("text")), normalize(F.col("title"))
    part = F.col("heading") & F.contains(name, own)
    head = F.coalesce(F.min(part.cast("int")).over(_before(_ordered(["doc_id", "start"], "ord"))), F.lit(1)) == 1
    return rows.withColumn("gone", (F.col("heading") & (own == name)) | (part & head)).filter("not gone").select(*_CHAPTERED)


def by_headings(blocks: DataFrame) -> DataFrame:
    """blocks without headings, in chapters that begin with one; headings in a row are one title, and what stands before the first is front matter."""
    along = _ordered(["doc_id"], "ord")
    opens = F.col("heading") & ~F.coalesce(F.lag("heading").over(along), F.lit(False))
    rows = blocks.withColumn("start", F.sum(opens.cast("int")).over(along))
    titles = F.array_sort(F.collect_list(F.when(F.col("heading"), F.struct("ord", "text"))).over(Window.partitionBy("doc_id", "start")))
    title = F.array_join(F.transform(titles, lambda t: t["text"]), JOINT)
    named = rows.withColumn("title", F.when(F.col("start") == 0, FRONT).otherwise(title))
    return named.filter(~F.col("heading")).select(*_CHAPTERED)


def by_pages(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """blocks in one chapter of the document's title, or, beyond 40 pages, in chapters of 20. documents: doc_id, pages, title."""
    bucket = F.floor((F.col("page") - 1) / PAGES_EACH)
    rows = blocks.join(documents.select("doc_id", "pages", F.col("title").alias("named")), "doc_id")
    start = F.when(F.col("pages") <= ONE_CHAPTER, 0).otherwise(bucket)
    span = F.concat(F.lit("Pages "), bucket * PAGES_EACH + 1, F.lit("–"), F.least("pages", (bucket + 1) * PAGES_EACH))
    title = F.when(F.col("pages") <= ONE_CHAPTER, F.when(F.coalesce("named", F.lit("")) != "", F.col("named")).otherwise("Full text")).otherwise(span)
    return rows.withColumns({"start": start, "title": title}).select(*_CHAPTERED)


def _entries(outline: DataFrame, documents: DataFrame) -> DataFrame:
    return documents.join(outline.groupBy("doc_id").agg(F.count("*").alias("entries")), "doc_id", "left")


def _strategy() -> Column:
    """Outline with two entries or more, else headings if there are a fitting number, else page buckets."""
    fits = F.col("heads").between(F.lit(HEADS), F.greatest(F.lit(MOST_HEADS), HEADS_A_PAGE * F.col("pages")))
    return F.when(F.col("entries") >= ENTRIES, "outline").when(fits, "headings").otherwise("pages")


def chapters(blocks: DataFrame, outline: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, strategy, c, title, p, page, text): each document's blocks in chapters by its own strategy; chapters without text are none."""
    facts = _entries(outline, documents).select("doc_id", "pages", "entries").hint("shuffle_hash")
    counted = blocks.withColumn("heads", F.sum(F.col("heading").cast("int")).over(Window.partitionBy("doc_id")))
    chosen = kept(counted.join(facts, "doc_id").select(*blocks.columns, _strategy().alias("strategy")), "blocks")
    mine = lambda name: chosen.filter(F.col("strategy") == name).drop("strategy")
    by = {"outline": by_outline(mine("outline"), outline), "headings": by_headings(mine("headings")), "pages": by_pages(mine("pages"), documents)}
    found = reduce(DataFrame.unionByName, [rows.withColumn("strategy", F.lit(name)) for name, rows in by.items()])
    c = F.dense_rank().over(_ordered(["doc_id"], "start")) - 1
    p = F.row_number().over(_ordered(["doc_id", "start"], "ord")) - 1
    return found.select("doc_id", "strategy", c.alias("c"), "title", p.alias("p"), "page", "text")


def read_pages(items: DataFrame, outlines: DataFrame, documents: DataFrame, recognised: DataFrame | None = None) -> DataFrame:
    """The chapters of documents of fixed pages, from their text items, outlines and recognised pages: all steps above in one plan."""
    lines = items_to_lines(items)
    left = strip_furniture(lines)
    blocks = lines_to_paragraphs(left)
    if recognised is not None:
        blocks = with_recognised(blocks, lines, recognised)
    return chapters(merge_pages(blocks), flat_outline(outlines), documents)
