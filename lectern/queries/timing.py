"""Times of words in units of 320 characters, over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import js_round
from ..operators import narration as N
from ..operators import timing as T
from ..plans.corpus import paragraphs
from ..plans.shared import kept
from ..registry import ORACLE_SQL, query, table
from . import narration, sql  # noqa: F401  narration's SQL packs the units


def _units(spark, sf_dir):
    return N.unit_texts(paragraphs(table(spark, sf_dir, "documents")), N.UNIT_CHARS["device"])


def _segments(units):
    """Segments for two sentences of three, by rule."""
    each = units.select(*T.UNIT, F.explode(F.sequence("s_start", F.col("s_end") - 1)).alias("s_start")).filter("s_start % 3 != 1")
    return each.select(*T.UNIT, "s_start", (F.col("s_start") + 1).alias("s_end"), (F.col("s_start") * F.lit(2.0)).alias("a"), (F.col("s_start") * F.lit(2.0) + 1.5).alias("b"))


def _facts(units):
    """What each unit has, by rule: characters, marked segments, a duration or nothing but its length."""
    kind = (F.col("doc_id") + F.col("c") + F.col("p") + F.col("unit")) % 4
    n = F.col("chars") + F.col("unit") % 3
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.lit(0.0625))
    return units.select(
        *T.UNIT, "s_start", "s_end", "chars", "texts", kind.alias("kind"), F.when(kind == 0, places).alias("starts"),
        F.when((kind == 0) & (F.col("unit") % 2 == 0), F.transform(places, lambda t: t + 0.0625)).alias("ends"), F.when(kind == 0, n).alias("n"), F.when(kind == 2, F.col("chars") / 12.0).alias("duration"),
    )


_BASE = ORACLE_SQL["unit_packing"].replace("SELECT doc_id, c, p, CAST(u AS INTEGER) AS unit", ", units AS (SELECT doc_id, c, p, CAST(u AS INTEGER) AS unit") + """),
pieces AS (SELECT doc_id, c, p, s, start, unnest(regexp_extract_all(text, '\\S+\\s*')) AS piece, generate_subscripts(regexp_extract_all(text, '\\S+\\s*'), 1) - 1 AS w FROM sentences),
ws AS (SELECT doc_id, c, p, s, CAST(w AS INTEGER) AS w, start + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, c, p, s ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place, regexp_extract(piece, '^\\S+') AS word FROM pieces),
uw AS (SELECT ws.doc_id, ws.c, ws.p, unit, s, w, CAST(place - min(place) OVER (PARTITION BY ws.doc_id, ws.c, ws.p, unit) AS INTEGER) AS char, CAST(length(word) AS INTEGER) AS len, word,
  length(word) + 1 + CASE WHEN regexp_matches(word, '[,;:]$') THEN 2.5 WHEN regexp_matches(word, '[.!?…]["”’)]*$') THEN 5.0 ELSE 0.0 END AS wt
  FROM ws JOIN units ON units.doc_id = ws.doc_id AND units.c = ws.c AND units.p = ws.p AND ws.s >= s_start AND ws.s < s_end)"""
_SPREAD = """CAST({a} AS DOUBLE) + (sum(wt) OVER (PARTITION BY {by} ORDER BY s, w) - wt) / sum(wt) OVER (PARTITION BY {by}) * ({b} - {a}) AS start, CAST({a} AS DOUBLE) + sum(wt) OVER (PARTITION BY {by} ORDER BY s, w) / sum(wt) OVER (PARTITION BY {by}) * ({b} - {a}) AS "end\""""
_BY = "doc_id, c, p, unit"
_FILL = f"""coalesce(last_value(start IGNORE NULLS) OVER (PARTITION BY {_BY} ORDER BY s, w), 0) AS start, coalesce(last_value("end" IGNORE NULLS) OVER (PARTITION BY {_BY} ORDER BY s, w), 0) AS "end\""""
_ROUNDED = f"""{sql.js_round('start', 3)} AS start, {sql.js_round('"end"', 3)} AS "end\""""


@query(f"{_BASE} SELECT doc_id, c, p, unit, s, w, char, len FROM uw")
def unit_words(spark, sf_dir):
    return T.unit_words(_units(spark, sf_dir))


@query(f"""{_BASE}, held AS (SELECT {_BY}, s, w, {_SPREAD.format(a='s * 2.0', b='(s * 2.0 + 1.5)', by=f'{_BY}, s')} FROM uw WHERE s % 3 <> 1),
filled AS (SELECT {_BY}, s, w, {_FILL} FROM uw LEFT JOIN held USING ({_BY}, s, w)) SELECT {_BY}, s, w, {_ROUNDED} FROM filled""")
def segment_times(spark, sf_dir):
    """Words of sentences without a segment take the times of the word before."""
    units = kept(_units(spark, sf_dir), "units")
    got = T.times_of_units(units, _segments(units))
    return got.select(*T.UNIT, "s", "w", *[js_round(F.col(c), 3).alias(c) for c in ("start", "end")])


_KIND = "(doc_id + c + p + unit) % 4"
_AT = "greatest(0, least(n - 1, CAST(floor(({}) * CASE WHEN n <> chars THEN n / chars ELSE 1.0 END + 0.5) AS BIGINT)))"


@query(f"""{_BASE}, k AS (SELECT *, {_KIND} AS kind, chars + unit % 3 AS n FROM units), wk AS (SELECT uw.*, kind, n, chars FROM uw JOIN k USING ({_BY})),
ch AS (SELECT {_BY}, s, w, {_AT.format('char')} * 0.0625 AS start, {_AT.format('char + len - 1')} * 0.0625 + CASE WHEN unit % 2 = 0 THEN 0.0625 ELSE 0 END AS "end", 'characters' AS how FROM wk WHERE kind = 0),
sg AS (SELECT {_BY}, s, w, {_SPREAD.format(a='s * 1.5', b='(CASE WHEN s = most THEN s * 1.5 + 3 ELSE (s + 1) * 1.5 END)', by=f'{_BY}, s')}, 'segments' AS how FROM (SELECT *, max(s) OVER (PARTITION BY {_BY}) AS most FROM wk WHERE kind = 1)),
le AS (SELECT {_BY}, s, w, {_SPREAD.format(a='0', b="(CASE WHEN kind = 2 THEN chars / 12.0 ELSE greatest(1.0, chars / 15.0) END)", by=_BY)}, CASE WHEN kind = 2 THEN 'duration' ELSE 'length' END AS how FROM wk WHERE kind > 1)
SELECT {_BY}, s, w, {_ROUNDED}, how FROM (SELECT * FROM ch UNION ALL SELECT * FROM sg UNION ALL SELECT * FROM le)""")
def unit_times(spark, sf_dir):
    """Every way to find times, each for a quarter of the units."""
    facts = _facts(kept(_units(spark, sf_dir), "units"))
    marks = facts.filter("kind = 1").select(*T.UNIT, F.explode(F.sequence("s_start", F.col("s_end") - 1)).alias("s"), F.lit(None).cast("double").alias("duration")).withColumn("t", F.col("s") * F.lit(1.5))
    got = T.all_times(facts, T.segments_from_marks(marks, T.UNIT))
    return got.select(*T.UNIT, "s", "w", *[js_round(F.col(c), 3).alias(c) for c in ("start", "end")], "how")


@query(f"""{_BASE}, q AS (SELECT {_BY}, CAST(unnest(range(0, chars, 40)) AS INTEGER) AS at FROM units)
SELECT q.doc_id, q.c, q.p, q.unit, q.at, uw.s, uw.w FROM q ASOF JOIN uw ON q.doc_id = uw.doc_id AND q.c = uw.c AND q.p = uw.p AND q.unit = uw.unit AND q.at >= uw.char""")
def word_at_char(spark, sf_dir):
    """The word at every fortieth character of a unit."""
    units = kept(_units(spark, sf_dir), "units")
    asked = units.filter("chars > 0").select(*T.UNIT, F.explode(F.sequence(F.lit(0), F.col("chars") - 1, F.lit(40))).alias("at"))
    return T.word_at(asked, units)
