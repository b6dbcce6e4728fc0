"""Narration data over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import js_round
from ..operators import narration as N
from ..plans.asof import asof_join
from ..plans.corpus import paragraphs
from ..registry import query, table
from . import sql


def _paras(spark, sf_dir):
    return paragraphs(table(spark, sf_dir, "documents"))


def _fold(name: str, cond: str, first: str, grow: str) -> str:
    """A recursive fold over the sentence lengths of each paragraph."""
    return f"""WITH RECURSIVE {sql.PARAS}, {sql.SENTENCES},
l AS (SELECT doc_id, c, p, list(length(text) ORDER BY s) AS x FROM sentences GROUP BY ALL),
f AS (SELECT doc_id, c, p, x, 1 AS i, 0 AS u, 0 AS s_start, {first.format(x='x[1]')} AS chars FROM l UNION ALL
  SELECT doc_id, c, p, x, i + 1, CASE WHEN {cond.format(x='x[i + 1]')} THEN u ELSE u + 1 END, CASE WHEN {cond.format(x='x[i + 1]')} THEN s_start ELSE i END, CASE WHEN {cond.format(x='x[i + 1]')} THEN {grow.format(x='x[i + 1]')} ELSE {first.format(x='x[i + 1]')} END FROM f WHERE i < len(x))
SELECT doc_id, c, p, CAST(u AS INTEGER) AS {name}, CAST(any_value(s_start) AS INTEGER) AS s_start, CAST(max(i) AS INTEGER) AS s_end, CAST(max(chars) AS INTEGER) AS chars FROM f GROUP BY doc_id, c, p, u"""


@query(_fold("unit", "chars + 1 + {x} <= 320", "{x}", "chars + 1 + {x}"))
def unit_packing(spark, sf_dir):
    """Units for slow devices: 320 characters."""
    return N.units(_paras(spark, sf_dir), N.UNIT_CHARS["device"])


_LAST = lambda mark: f"CASE WHEN contains(head, '{mark}') THEN length(head) - strpos(reverse(head), reverse('{mark}')) + 1 - {len(mark)} ELSE -1 END"
_GROUPS = _fold("grp", "chars + 1 + {x} <= 380 AND (chars < 60 OR {x} < 40)", "{x}", "chars + 1 + {x}")


@query(f"""{_GROUPS.replace("SELECT doc_id, c, p, CAST(u AS INTEGER) AS grp", ", g AS (SELECT doc_id, c, p, CAST(u AS INTEGER) AS grp")}),
long AS (SELECT g.doc_id, g.c, g.p, g.grp, string_agg(sentences.text, ' ' ORDER BY s) AS rest FROM g JOIN sentences ON sentences.doc_id = g.doc_id AND sentences.c = g.c AND sentences.p = g.p AND s >= s_start AND s < s_end WHERE g.chars > 420 GROUP BY ALL),
r AS (SELECT doc_id, c, p, grp, 0 AS i, '' AS piece, rest FROM long UNION ALL SELECT doc_id, c, p, grp, i + 1, left(rest, n), substr(rest, n + 1) FROM (
  SELECT *, CASE WHEN length(rest) <= 380 THEN length(rest) WHEN cut > 0 THEN cut + 1 ELSE 380 END AS n FROM (SELECT *, CASE WHEN greatest({", ".join(_LAST(m) for m in N.CUT_MARKS)}) < 152 THEN {_LAST(" ")} ELSE greatest({", ".join(_LAST(m) for m in N.CUT_MARKS)}) END AS cut
  FROM (SELECT *, left(rest, 380) AS head FROM r WHERE rest <> '')))),
cuts AS (SELECT doc_id, c, p, grp, row_number() OVER (PARTITION BY doc_id, c, p, grp ORDER BY i) - 1 AS part, length(piece) AS n FROM r WHERE i > 0 AND trim(piece) <> '')
SELECT g.doc_id, g.c, g.p, g.grp, s_start, s_end, CAST(coalesce(part, 0) AS INTEGER) AS part, CAST(coalesce(n, chars) AS INTEGER) AS chars FROM g LEFT JOIN cuts USING (doc_id, c, p, grp)""")
def sentence_groups(spark, sf_dir):
    return N.sentence_groups(_paras(spark, sf_dir))


_TIMES = f"""WITH {sql.PARAS}, w AS (SELECT doc_id, c, p, greatest(1.0, length(text) / 15.0) AS dur, unnest(regexp_extract_all(text, '\\S+')) AS word, generate_subscripts(regexp_extract_all(text, '\\S+'), 1) - 1 AS w FROM paras),
wt AS (SELECT *, length(word) + 1 + CASE WHEN regexp_matches(word, '[,;:]$') THEN 2.5 WHEN regexp_matches(word, '[.!?…]["”’)]*$') THEN 5.0 ELSE 0.0 END AS wt FROM w),
t AS (SELECT doc_id, c, p, CAST(w AS INTEGER) AS w, (sum(wt) OVER o - wt) / sum(wt) OVER (PARTITION BY doc_id, c, p) * dur AS start, sum(wt) OVER o / sum(wt) OVER (PARTITION BY doc_id, c, p) * dur AS "end" FROM wt WINDOW o AS (PARTITION BY doc_id, c, p ORDER BY w))"""


@query(f"{_TIMES} SELECT doc_id, c, p, w, {sql.js_round('start', 3)} AS start, {sql.js_round('\"end\"', 3)} AS \"end\" FROM t")
def spread_times(spark, sf_dir):
    return N.spread_times(_paras(spark, sf_dir)).withColumns({c: js_round(F.col(c), 3) for c in ("start", "end")})


@query(f"{_TIMES}, r AS (SELECT doc_id, c, p, w, {sql.js_round('start', 3)} AS start FROM t), m AS (SELECT doc_id, c, p, CAST(floor(max(start) / 5) AS INTEGER) AS n FROM r GROUP BY ALL), q AS (SELECT doc_id, c, p, unnest(generate_series(0, n)) * 5 AS at FROM m) SELECT q.doc_id, q.c, q.p, CAST(q.at AS INTEGER) AS at, r.w FROM q ASOF JOIN r ON q.doc_id = r.doc_id AND q.c = r.c AND q.p = r.p AND q.at + 0.02 >= r.start")
def asof_word(spark, sf_dir):
    """The word that is spoken at every fifth second, with 20 ms of grace."""
    t = N.spread_times(_paras(spark, sf_dir)).select("doc_id", "c", "p", "w", js_round(F.col("start"), 3).alias("start"))
    asked = t.groupBy("doc_id", "c", "p").agg(F.floor(F.max("start") / 5).cast("int").alias("n")).select("doc_id", "c", "p", F.explode(F.sequence(F.lit(0), "n")).alias("k"))
    asked = asked.select("doc_id", "c", "p", (F.col("k") * 5).alias("at"), (F.col("k") * 5 + F.lit(0.02)).cast("double").alias("t"))
    return asof_join(asked, t, ["doc_id", "c", "p"], "t", "start").select("doc_id", "c", "p", "at", "w")


@query("""WITH RECURSIVE cl AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations), k AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM cl WHERE text <> ''),
l AS (SELECT conv_id, list(text ORDER BY turn) AS x FROM k WHERE prev IS NULL OR prev <> text GROUP BY conv_id),
f AS (SELECT conv_id, x, 1 AS i, 0 AS n, x[1] AS cur FROM l UNION ALL
 SELECT conv_id, x, i + 1, CASE WHEN length(cur) > 450 AND regexp_matches(cur, '[.!?…"”]$') THEN n + 1 ELSE n END, CASE WHEN length(cur) > 450 AND regexp_matches(cur, '[.!?…"”]$') THEN x[i + 1] ELSE cur || ' ' || x[i + 1] END FROM f WHERE i < len(x))
SELECT conv_id, CAST(n AS INTEGER) AS para, arg_max(cur, i) AS text FROM f GROUP BY conv_id, n""")
def cue_coalesce(spark, sf_dir):
    return N.coalesce_cues(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("""WITH RECURSIVE ev AS (SELECT user_id, event_id, ts, epoch_us(ts) AS us, coalesce(value, 0) * 10 AS chars, (lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts)) / 60000000 AS seconds FROM events),
ok AS (SELECT user_id, list(chars / seconds ORDER BY us, event_id) AS x FROM ev WHERE seconds > 0.5 AND chars > 20 AND chars / seconds > 5 AND chars / seconds < 40 GROUP BY user_id),
f AS (SELECT user_id, x, 0 AS i, CAST(15.5 AS DOUBLE) AS cps FROM ok UNION ALL SELECT user_id, x, i + 1, cps * 0.7 + x[i + 1] * 0.3 FROM f WHERE i < len(x))
SELECT user_id, round(cps, 6) AS cps FROM f WHERE i = len(x)""")
def ewma_rate(spark, sf_dir):
    """Events as observations: ten characters a unit of value, a second a minute until the user's next event."""
    from pyspark.sql import Window

    from ..operators.sessions import micros

    us = micros(F.col("ts"))
    gap = (F.lead("us").over(Window.partitionBy("user_id").orderBy("us", "event_id")) - F.col("us")) / 60_000_000
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", us.alias("us"), (F.coalesce("value", F.lit(0.0)) * 10).alias("chars")).withColumn("seconds", gap)
    return N.learned_rate(rows, "user_id", ["us", "event_id"]).select("user_id", F.round("cps", 6).alias("cps"))


@query("""WITH v AS (SELECT s_name AS voice, CASE s_nationkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'xx' END AS lang, CAST(floor(s_acctbal / 100) AS BIGINT) AS q FROM supplier),
b AS (SELECT lang, arg_min(voice, {'a': -q, 'b': voice}) AS best FROM v GROUP BY lang)
SELECT d.doc_id AS id, coalesce(o.voice, b.best, e.best) AS voice FROM documents d LEFT JOIN v o ON o.voice = 'Supplier#' || lpad(CAST(d.doc_id * 7 AS VARCHAR), 9, '0') LEFT JOIN b ON b.lang = d.lang LEFT JOIN b e ON e.lang = 'en'""")
def voice_choice(spark, sf_dir):
    """Suppliers as voices; each document asks for its language's, some by name."""
    n = F.col("s_nationkey") % 4
    lang = F.when(n == 0, "en").when(n == 1, "fr").when(n == 2, "de").otherwise("xx")
    voices = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("voice"), lang.alias("lang"), F.floor(F.col("s_acctbal") / 100).alias("quality"))
    wanted = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.concat(F.lit("Supplier#"), F.lpad((F.col("doc_id") * 7).cast("string"), 9, "0")).alias("override"))
    return N.choose_voice(wanted, voices)
