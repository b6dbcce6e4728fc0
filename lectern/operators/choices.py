"""Small decisions over rows: which file, which label, which page, how far, how much is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_words, js_round

#: Ranks of voice grades.
GRADES = {"A": 9, "A-": 8, "B+": 7, "B": 6, "B-": 5, "C+": 4, "C": 3, "C-": 2, "D+": 1, "D": 0, "D-": -1, "F+": -2, "F": -3}
#: Characters of narration in a second.
CHARS_PER_SECOND = 15


def best_file(files: DataFrame, by: str) -> DataFrame:
    """One file of each item: the largest plain text over 2000 bytes, else the first EPUB, else scanned text; none of other kinds."""
    place = F.when((F.col("kind") == "txt") & (F.col("bytes") > 2000), F.struct(F.lit(0).alias("p"), (-F.col("bytes")).cast("double").alias("s"))).when(F.col("kind") == "epub", F.struct(F.lit(1).alias("p"), F.lit(0.0).alias("s"))).when(F.col("kind") == "djvu", F.struct(F.lit(2).alias("p"), F.lit(0.0).alias("s")))
    ranked = files.withColumn("_place", place).filter("_place is not null")
    return ranked.groupBy(by).agg(F.min_by(F.struct("name", "kind"), F.struct("_place", "name")).alias("f")).select(by, "f.name", "f.kind")


def availability(full_text: Column, access: Column) -> Column:
    return F.when(full_text, "full text").when(access == "public", "download").when(access.isin("borrowable", "printdisabled"), "borrow").otherwise("look up")


def grade_rank(grade: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in GRADES.items() for x in pair]), grade)


def page_number(lines: Column) -> Column:
    """The printed page number: the first of one to four digits alone on the first or last three lines, else one that ends the first line."""
    n = F.size(lines)
    edges = F.when(n <= 6, lines).otherwise(F.concat(F.slice(lines, 1, 3), F.slice(lines, n - 2, F.lit(3))))
    alone = F.filter(edges, lambda x: x.rlike(r"^\s*[0-9]{1,4}\s*$"))
    first = F.regexp_extract(F.element_at(lines, 1), r"\s([0-9]{1,4})\s*$", 1)
    return F.when(F.size(alone) > 0, F.trim(F.element_at(alone, 1)).cast("int")).when(first != "", first.cast("int"))


def readiness(required: DataFrame, present: DataFrame, group: str, key: str) -> DataFrame:
    """(group, needed, have, all_ready, any_ready) after a left join with what is there."""
    flagged = required.join(present.select(key).distinct().withColumn("_there", F.lit(True)), key, "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    return flagged.groupBy(group).agg(F.count("*").alias("needed"), F.count_if("_there").alias("have"), F.every("_there").alias("all_ready"), F.some("_there").alias("any_ready"))


def allowance(used: Column, limit: Column) -> tuple[Column, Column, Column]:
    """Percent used, characters left, and minutes of narration that they last."""
    left = F.greatest(F.lit(0), limit - used)
    return js_round(F.least(F.lit(1.0), used / limit) * 100), left, js_round(left / CHARS_PER_SECOND / 60, 1)


def last_of_window(rows: DataFrame, by: list[str], us: str, value: str, width_us: int) -> DataFrame:
    """Trailing-edge debounce: the last value in each window of time."""
    return rows.groupBy(*by, F.floor(F.col(us) / width_us).alias("slot")).agg(F.max_by(value, F.struct(us, "event_id")).alias(value), F.count("*").alias("events"))


def skip(placed: DataFrame, n: int) -> DataFrame:
    """Each sentence (doc_id, c, p, s) with the keys n before and n after it; the ends of the book hold."""
    w = Window.partitionBy("doc_id").orderBy("c", "p", "s")
    loc = F.concat_ws(".", "c", "p", "s")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return placed.select("doc_id", loc.alias("loc"), F.coalesce(F.lag(loc, n).over(w), F.first(loc).over(whole)).alias("back"), F.coalesce(F.lead(loc, n).over(w), F.last(loc).over(whole)).alias("ahead"))


def next_unit(units: DataFrame) -> DataFrame:
    """Where narration goes on after each unit: the next sentence of the paragraph, else the next paragraph."""
    w = Window.partitionBy("doc_id").orderBy("c", "p", "unit")
    return units.select("doc_id", "c", "p", "unit", F.lead(F.concat_ws(".", "c", "p", "s_start")).over(w).alias("next"))


def clamp_locator(locs: DataFrame, placed: DataFrame) -> DataFrame:
    """locs (doc_id, c, p, s, w) held inside the book: each level to what there is, in turn."""
    counts = placed.groupBy("doc_id", "c", "p").agg(F.max("s").alias("last_s"), F.collect_list(F.struct("s", "n_words")).alias("ws"))
    paras = placed.groupBy("doc_id", "c").agg(F.max("p").alias("last_p"))
    chapters = placed.groupBy("doc_id").agg(F.max("c").alias("last_c"))
    clamp = lambda x, top: F.greatest(F.lit(0), F.least(x, top))
    rows = locs.join(chapters, "doc_id").withColumn("c", clamp("c", "last_c")).join(paras, ["doc_id", "c"]).withColumn("p", clamp("p", "last_p")).join(counts, ["doc_id", "c", "p"]).withColumn("s", clamp("s", "last_s"))
    n = F.element_at(F.transform(F.filter("ws", lambda x: x["s"] == F.col("s")), lambda x: x["n_words"]), 1)
    return rows.select("doc_id", "at", "c", "p", "s", clamp("w", n - 1).alias("w"))


def ocr_paragraphs(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, para, text) of recognised lines (by, line, text): page numbers off, capital heads alone, hyphenated words rejoined, two words at least."""
    w = Window.partitionBy(*by).orderBy("line")
    kept = lines.filter(~F.trim("text").rlike(r"^[0-9]{1,4}$"))
    head = (F.length("text") < 60) & F.col("text").rlike("[A-Z]{3}") & ~F.col("text").rlike(r"\p{Ll}")
    rows = kept.withColumn("head", head).withColumn("after", F.lag("text").over(w))
    new = F.col("after").isNull() | F.col("head") | F.coalesce(F.lag("head").over(w), F.lit(False)) | F.col("after").rlike("[.!?…\"”’]$")
    parts = rows.withColumn("para", F.sum(new.cast("int")).over(w)).groupBy(*by, "para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda t: t["text"]), "\n").alias("t"))
    text = F.regexp_replace(F.regexp_replace("t", r"(\p{Ll})-\n(\p{Ll})", "$1$2"), "\n", " ")
    return parts.select(*by, F.col("para").cast("int").alias("para"), text.alias("text")).filter(count_words(F.col("text")) >= 2)
