"""Locators, global offsets, walks, progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import js_round, words
from ..operators import locators as L
from ..plans.corpus import offsets, paragraphs
from ..plans.shared import kept
from ..registry import query, table
from . import sql

_BASE = f"WITH {sql.PARAS}, {sql.OFFSETS}"
_PLACED = f"{_BASE}, {sql.SENTENCES}, placed AS (SELECT s.doc_id, s.c, s.p, s.s, s.n_words, s.word_start, o.g + s.word_start AS g, o.total FROM sentences s JOIN offs o USING (doc_id, c, p))"


def _paras(spark, sf_dir):
    return paragraphs(table(spark, sf_dir, "documents"))


def _placed(paras):
    """Sentences with their places, kept: numbers alone, so that texts are taken apart once however often they are read."""
    return kept(L.sentence_offsets(paras), "sentences")


@query(f"{_BASE} SELECT doc_id, c, p, pwc, g, total FROM offs")
def locator_offsets(spark, sf_dir):
    return offsets(_paras(spark, sf_dir))


@query(f"{_BASE} SELECT doc_id, c, CAST(sum(pwc) AS BIGINT) AS words, min(g) AS start_g, count(*) AS paragraphs FROM offs GROUP BY doc_id, c")
def chapter_words(spark, sf_dir):
    return offsets(_paras(spark, sf_dir)).groupBy("doc_id", "c").agg(F.sum("pwc").alias("words"), F.min("g").alias("start_g"), F.count("*").alias("paragraphs"))


@query(f"{_PLACED} SELECT doc_id, c, p, s, n_words + 2 AS w, g + n_words - 1 AS g FROM placed")
def loc_to_global(spark, sf_dir):
    """A word past the end of each sentence, which is clamped to its last word."""
    placed = _placed(_paras(spark, sf_dir))
    return L.loc_to_global(placed.select("doc_id", "c", "p", "s", (F.col("n_words") + 2).alias("w")), placed)


@query(f"""{_PLACED}, q AS (SELECT doc_id, g + pwc // 2 AS q FROM offs UNION ALL SELECT DISTINCT doc_id, total + 5 FROM offs),
cl AS (SELECT q.doc_id, q.q, greatest(0, least(q.q, o.total - 1)) AS g FROM q JOIN (SELECT DISTINCT doc_id, total FROM offs) o USING (doc_id))
SELECT cl.doc_id, cl.q, x.c, x.p, x.s, cl.g - x.g AS w FROM cl ASOF JOIN (SELECT * FROM placed WHERE n_words > 0) x ON cl.doc_id = x.doc_id AND cl.g >= x.g""")
def global_to_loc(spark, sf_dir):
    """The middle word of each paragraph, and a point past each book's end."""
    paras = _paras(spark, sf_dir)
    offs = offsets(paras)
    points = offs.select("doc_id", (F.col("g") + F.floor(F.col("pwc") / 2)).alias("q")).union(offs.select("doc_id", F.col("total") + 5).distinct())
    return L.global_to_loc(points, _placed(paras))


@query(f"{_BASE} SELECT count(*) AS points, CAST(0 AS BIGINT) AS mismatches FROM offs")
def locator_round_trip(spark, sf_dir):
    """g to locator to g, over the middle of all paragraphs."""
    paras = _paras(spark, sf_dir)
    placed = _placed(paras)
    points = offsets(paras).select("doc_id", (F.col("g") + F.floor(F.col("pwc") / 2)).alias("q"))
    back = L.loc_to_global(L.global_to_loc(points, placed), placed)
    return back.agg(F.count("*").alias("points"), F.count_if(~F.col("g").eqNullSafe(F.col("q"))).alias("mismatches"))


@query(f"{_PLACED}, k AS (SELECT *, c || '.' || p || '.' || s AS loc FROM placed WHERE n_words > 0) SELECT doc_id, loc, lag(loc) OVER w AS prev_loc, lead(loc) OVER w AS next_loc FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY c, p, s)")
def next_prev_sentence(spark, sf_dir):
    return L.walk(L.sentence_offsets(_paras(spark, sf_dir)))


@query(f"{_BASE} SELECT doc_id, c, p, {sql.js_round('least(1.0, g / total)', 4)} AS percent FROM offs")
def percent_position(spark, sf_dir):
    return offsets(_paras(spark, sf_dir)).select("doc_id", "c", "p", js_round(F.least(F.lit(1.0), F.col("g") / F.col("total")), 4).alias("percent"))


@query(f"{_BASE}, ch AS (SELECT *, sum(pwc) OVER (PARTITION BY doc_id, c) AS cw, min(g) OVER (PARTITION BY doc_id, c) AS cg FROM offs) SELECT doc_id, c, p, CAST(cw - (g - cg) AS BIGINT) AS words_left, {sql.js_round('(cw - (g - cg)) / 230', 2)} AS minutes_left FROM ch")
def time_left(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "c")
    rows = offsets(_paras(spark, sf_dir)).withColumn("left", F.sum("pwc").over(w) - (F.col("g") - F.min("g").over(w)))
    return rows.select("doc_id", "c", "p", F.col("left").alias("words_left"), js_round(F.col("left") / 230, 2).alias("minutes_left"))


@query(f"WITH {sql.PARAS}, x AS (SELECT doc_id, c, p, regexp_extract_all(text, '\\S+') AS w FROM paras) SELECT doc_id, c, p, array_to_string(w[1:14], ' ') || CASE WHEN len(w) >= 14 THEN '…' ELSE '' END AS snippet FROM x")
def snippet(spark, sf_dir):
    some = _paras(spark, sf_dir).select("doc_id", "c", "p", words(F.col("text")).alias("w"))
    return some.select("doc_id", "c", "p", F.concat(F.array_join(F.slice("w", 1, 14), " "), F.when(F.size("w") >= 14, "…").otherwise("")).alias("snippet"))
