"""Sessions, streaks, pace, labels and taste. Events are activity (user_id is the book); parts are works, line items time spent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import js_round, normalize
from ..operators import sessions as S
from ..operators import taste as T
from ..plans.corpus import paragraphs
from ..registry import query, table
from . import sql


def _sql_sessions(idle_s: int) -> str:
    return f"""ev AS (SELECT user_id AS book_id, event_id, ts, epoch_us(ts) AS us, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'listen' WHEN 'purchase' THEN 'physical' ELSE event_type END AS mode, CAST(floor(coalesce(value, 0)) AS BIGINT) AS words FROM events),
ch AS (SELECT *, CASE WHEN lag(mode) OVER w = mode THEN 0 ELSE 1 END AS changed, lead(us) OVER w AS next_us FROM ev WINDOW w AS (PARTITION BY book_id ORDER BY us, event_id)),
isl AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY book_id ORDER BY us, event_id) AS BIGINT) AS nth FROM ch),
agg AS (SELECT book_id, nth, any_value(mode) AS mode, min(ts) AS start, max(ts) AS "end", CAST(floor(sum(CASE WHEN next_us IS NULL THEN 0 ELSE least({idle_s}000000, next_us - us) END) / 1000) AS BIGINT) AS ms, CAST(greatest(0, sum(words)) AS BIGINT) AS words, count(*) AS events FROM isl GROUP BY book_id, nth),
sess AS (SELECT *, floor(ms / 6000 + 0.5) / 10 AS minutes, CAST(start AS DATE) AS day, CAST(floor(ms / 6000 + 0.5) AS BIGINT) AS tn FROM agg WHERE ms >= 20000 OR words >= 30)"""


_S, _S6 = f"WITH {_sql_sessions(120)}", f"WITH {_sql_sessions(21600)}"


def _sessions(spark, sf_dir, idle_s=S.IDLE_S):
    return S.sessions(S.activity(table(spark, sf_dir, "events")), idle_s)


@query(f"{_S} SELECT book_id, nth, mode, start, \"end\", ms, words, events FROM sess")
def sessionize(spark, sf_dir):
    return _sessions(spark, sf_dir).select("book_id", "nth", "mode", "start", "end", "ms", "words", "events")


@query(f"{_S6} SELECT book_id || '-' || nth AS id, book_id, mode, CAST(day AS VARCHAR) AS day, minutes, words FROM sess")
def session_rows(spark, sf_dir):
    """With an idle limit of six hours."""
    rows = _sessions(spark, sf_dir, 21600)
    return rows.select(F.concat_ws("-", "book_id", "nth").alias("id"), "book_id", "mode", F.col("day").cast("string").alias("day"), "minutes", "words")


_MOVES = f"""{_S}, mv AS (SELECT isl.*, CASE WHEN e.event_type <> 'signup' THEN CAST(json_extract_string(e.props, '$.k') AS BIGINT) END AS g, CASE WHEN e.event_type = 'purchase' THEN CAST(floor(e.value) AS BIGINT) END AS page FROM isl JOIN events e USING (event_id))"""


@query(f"""{_MOVES}, a AS (SELECT book_id, nth, any_value(mode) AS mode, arg_min(g, (us, event_id)) FILTER (g IS NOT NULL) AS g_start, arg_max(g, (us, event_id)) FILTER (g IS NOT NULL) AS g_end,
arg_min(page, (us, event_id)) FILTER (page IS NOT NULL) AS page_start, arg_max(page, (us, event_id)) FILTER (page IS NOT NULL) AS page_end FROM mv GROUP BY book_id, nth)
SELECT *, greatest(0, coalesce(g_end - g_start, 0)) AS g_words, greatest(0, coalesce(page_end - page_start, 0)) AS pages FROM a""")
def session_positions(spark, sf_dir):
    return S.session_positions(S.moves(table(spark, sf_dir, "events")))


@query("SELECT user_id AS book_id, max(epoch_us(ts)) AS last_us, (SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts)) < 7200000000 AS active FROM events GROUP BY user_id")
def is_active(spark, sf_dir):
    """At the last event of all, with two hours in place of two minutes, as events lie far apart."""
    rows = S.activity(table(spark, sf_dir, "events"))
    return S.is_active(rows, F.lit(rows.agg(F.max("us")).first()[0]), 7200)


@query(f"""{_S}, e2 AS (SELECT book_id, nth, max(us) AS last_us, count(*) AS events FROM isl GROUP BY ALL), o AS (SELECT *, nth = max(nth) OVER (PARTITION BY book_id) AS open FROM e2)
SELECT * FROM o WHERE NOT open OR (SELECT max(us) FROM isl) - last_us < 5400000000""")
def live_sessions(spark, sf_dir):
    """At the last event of all, with an hour and a half for the open session."""
    rows = S.activity(table(spark, sf_dir, "events"))
    return S.live(rows, F.lit(rows.agg(F.max("us")).first()[0]), 90 * 60)


_DAILY = "d AS (SELECT day, sum(tn) / 10 AS minutes, CAST(sum(words) AS BIGINT) AS words, count(*) AS sessions, coalesce(sum(tn) FILTER (mode = 'listen'), 0) / 10 AS listen FROM sess GROUP BY day)"
_DAYS = "days AS (SELECT CAST(unnest(generate_series(t - INTERVAL 29 DAY, t, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT max(day) AS t FROM sess)), z AS (SELECT days.day, coalesce(minutes, 0) AS minutes, coalesce(words, 0) AS words, coalesce(sessions, 0) AS sessions, coalesce(listen, 0) AS listen FROM days LEFT JOIN d USING (day))"


@query(f"{_S}, {_DAILY}, {_DAYS} SELECT CAST(day AS VARCHAR) AS day, minutes, words, sessions, listen FROM z")
def daily_rollup(spark, sf_dir):
    rows = S.daily(_sessions(spark, sf_dir), F.max("day"))
    return rows.withColumn("day", F.col("day").cast("string"))


@query(f"{_S}, {_DAILY}, {_DAYS} SELECT {sql.js_round('sum(minutes)', 1)} AS minutes, CAST(sum(words) AS BIGINT) AS words, CAST(sum(sessions) AS BIGINT) AS sessions FROM (SELECT * FROM z ORDER BY day DESC LIMIT 7)")
def last7(spark, sf_dir):
    rows = S.daily(_sessions(spark, sf_dir), F.max("day"), 7)
    return rows.agg(js_round(F.sum("minutes"), 1).alias("minutes"), F.sum("words").alias("words"), F.sum("sessions").alias("sessions"))


@query(f"""{_S}, now AS (SELECT book_id, max(day) AS today FROM sess GROUP BY book_id), act AS (SELECT book_id, day FROM sess GROUP BY ALL HAVING sum(tn) / 10 >= 1),
r AS (SELECT book_id, day - CAST(row_number() OVER (PARTITION BY book_id ORDER BY day) AS INTEGER) AS run, day FROM act), runs AS (SELECT book_id, run, count(*) AS n, max(day) AS last FROM r GROUP BY ALL)
SELECT now.book_id, coalesce(max(n) FILTER (last >= today - 1), 0) AS current, coalesce(max(n), 0) AS best, CAST(coalesce(sum(n), 0) AS BIGINT) AS active_days, coalesce(bool_or(last = today), false) AS today
FROM now LEFT JOIN runs USING (book_id) GROUP BY now.book_id""")
def streaks(spark, sf_dir):
    return S.streaks(_sessions(spark, sf_dir), F.max("day"), ["book_id"])


@query(f"""{_S} SELECT sum(tn) / 10 AS minutes, CAST(sum(words) AS BIGINT) AS words, count(*) AS sessions, sum(tn) FILTER (mode = 'listen') / 10 AS listen_minutes, sum(tn) FILTER (mode = 'physical') / 10 AS physical_minutes, count(DISTINCT book_id) AS books FROM sess""")
def totals(spark, sf_dir):
    rows = _sessions(spark, sf_dir)
    by_book = rows.groupBy("book_id").agg(*[F.sum(F.round(F.col("minutes") * 10).cast("long") * w).alias(n) for n, w in (("m", F.lit(1)), ("l", (F.col("mode") == "listen").cast("int")), ("p", (F.col("mode") == "physical").cast("int")))], F.sum("words").alias("w"), F.count("*").alias("s"))
    return by_book.agg((F.sum("m") / 10).alias("minutes"), F.sum("w").alias("words"), F.sum("s").alias("sessions"), (F.sum("l") / 10).alias("listen_minutes"), (F.sum("p") / 10).alias("physical_minutes"), F.count("*").alias("books"))


_STATS = """st AS (SELECT book_id, sum(tn) / 10 AS minutes, count(*) AS sessions, CAST(sum(words) AS BIGINT) AS words,
  CASE WHEN coalesce(sum(tn) FILTER (r), 0) / 10 >= 1 THEN CAST(floor(sum(words) FILTER (r) / (sum(tn) FILTER (r) / 10) + 0.5) AS BIGINT) END AS wpm,
  coalesce(sum(tn) FILTER (mode = 'listen'), 0) / 10 AS listen_minutes, coalesce(sum(tn) FILTER (mode = 'physical'), 0) / 10 AS physical_minutes, max("end") AS last_read, min(start) AS first_read
  FROM (SELECT *, mode = 'read' AND words > 30 AND minutes >= 0.5 AS r FROM sess) GROUP BY book_id)"""


@query(f"{_S}, {_STATS} SELECT * FROM st")
def book_stats(spark, sf_dir):
    return S.book_stats(_sessions(spark, sf_dir), ["book_id"])


@query(f"{_S6} SELECT CASE WHEN sum(tn) / 10 >= 2 THEN CAST(floor(sum(words) / (sum(tn) / 10) + 0.5) AS BIGINT) END AS wpm FROM sess WHERE mode = 'read' AND words > 30 AND minutes >= 0.5")
def user_wpm(spark, sf_dir):
    rows = _sessions(spark, sf_dir, 21600)
    return rows.agg(S.user_wpm(rows).alias("wpm"))


@query(f"""{_S}, h AS (SELECT CASE WHEN hour(start) >= 21 THEN 'bedtime reader' WHEN hour(start) >= 17 THEN 'evening reader' WHEN hour(start) >= 12 THEN 'afternoon reader' WHEN hour(start) >= 8 THEN 'morning reader' WHEN hour(start) >= 5 THEN 'early riser' ELSE 'night owl' END AS slot, min(hour(start)) AS first_hour, sum(tn) / 10 AS minutes FROM sess GROUP BY 1)
SELECT slot, minutes, row_number() OVER (ORDER BY minutes DESC, first_hour) = 1 AND sum(minutes) OVER () > 10 AS best FROM h""")
def hour_slots(spark, sf_dir):
    from pyspark.sql import Window

    hour = F.hour("start")
    rows = _sessions(spark, sf_dir).groupBy(S.slot(hour).alias("slot")).agg(F.min(hour).alias("first_hour"), S.tenths().alias("minutes"))
    w = Window.partitionBy(F.lit(1))  # six rows
    return rows.select("slot", "minutes", ((F.row_number().over(w.orderBy(F.col("minutes").desc(), "first_hour")) == 1) & (F.sum("minutes").over(w) > 10)).alias("best"))


_SHELF = """q AS (SELECT l_partkey AS k, sum(l_quantity) AS minutes FROM lineitem GROUP BY 1),
shelf AS (SELECT p_partkey AS book_id, p_type, p_brand, p_name, CAST(floor(p_retailprice * 100) AS BIGINT) AS words, coalesce(minutes, 0) AS minutes, least(1.0, coalesce(minutes, 0) / (p_size * 40.0)) AS percent FROM part LEFT JOIN q ON k = p_partkey),
wt AS (SELECT *, percent >= 0.98 AS done, 0.25 + 0.75 * percent + CASE WHEN percent >= 0.98 THEN 0.6 ELSE 0 END + least(1.0, minutes / 120) * 0.6 AS w FROM shelf)"""


def _shelf(spark, sf_dir):
    """Parts as books: minutes are quantities ordered, the length is the price in cents, a book is read at 40 minutes a size unit."""
    minutes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("minutes"))
    rows = table(spark, sf_dir, "part").join(minutes, "p_partkey", "left").withColumn("minutes", F.coalesce("minutes", F.lit(0.0)))
    rows = rows.withColumn("percent", F.least(F.lit(1.0), F.col("minutes") / (F.col("p_size") * 40.0)))
    done = F.col("percent") >= T.DONE
    return rows.select(F.col("p_partkey").alias("book_id"), "p_type", "p_brand", "p_name", F.floor(F.col("p_retailprice") * 100).alias("words"), "minutes", "percent", done.alias("done"), T.weight(F.col("percent"), done, F.col("minutes")).alias("w"))


@query(f"""WITH {_SHELF}, s AS (SELECT {sql.norm('p_type')} AS key, arg_min(p_type, book_id) AS name, round(sum(w), 6) AS weight, count(*) AS books, min(book_id) AS ord FROM wt GROUP BY 1 HAVING key <> ''),
t AS (SELECT * FROM s ORDER BY weight DESC, ord LIMIT 8) SELECT key, name, {sql.js_round('weight / max(weight) OVER ()', 2)} AS weight, books FROM t""")
def taste_subjects(spark, sf_dir):
    return T.taste(_shelf(spark, sf_dir).select(F.col("p_type").alias("name"), "w", F.col("book_id").alias("ord")), 8, True).drop("ord")


@query(f"""WITH {_SHELF}, s AS (SELECT {sql.norm('p_brand')} AS key, arg_min(trim(p_brand), book_id) AS name, round(sum(w), 6) AS weight, count(*) AS books, min(book_id) AS ord FROM wt GROUP BY 1 HAVING key <> '')
SELECT key, name, weight, books FROM s ORDER BY weight DESC, ord LIMIT 5""")
def taste_authors(spark, sf_dir):
    rows = _shelf(spark, sf_dir).select(T.first_author(F.col("p_brand")).alias("name"), "w", F.col("book_id").alias("ord"))
    return T.taste(rows, 5, False).drop("ord")


@query(f"""WITH {_SHELF}, f AS (SELECT list_sort(list(words) FILTER (done)) AS a, list_sort(list(words) FILTER (percent > 0.3)) AS b, list_sort(list(words)) AS c FROM wt)
SELECT coalesce(a[len(a) // 2 + 1], b[len(b) // 2 + 1]) AS preferred_words, {sql.js_round('coalesce(a[len(a) // 2 + 1], b[len(b) // 2 + 1]) / 280')} AS preferred_pages, c[len(c) // 2 + 1] AS median_words FROM f""")
def preferred_length(spark, sf_dir):
    """Medians over distinct lengths and how often each occurs: no list of all books is built."""
    from ..plans.ranks import upper_median_by_counts

    rows = _shelf(spark, sf_dir)
    sets = rows.select("words", F.explode(F.filter(F.array(F.when(F.col("done"), "done"), F.when(F.col("percent") > 0.3, "some"), F.lit("all")), lambda x: x.isNotNull())).alias("set"))
    m = upper_median_by_counts(sets, "set", "words").groupBy().pivot("set", ["done", "some", "all"]).agg(F.first("median"))
    pref = F.coalesce("done", "some")
    return m.select(pref.alias("preferred_words"), js_round(pref / 280).alias("preferred_pages"), F.col("all").alias("median_words"))


@query("SELECT coalesce((SELECT lower(lang[1:2]) AS l FROM documents WHERE lang IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, min(doc_id) LIMIT 1), 'en') AS language")
def dominant_language(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("lang is not null").groupBy(F.lower(F.substring("lang", 1, 2)).alias("l")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return rows.agg(F.coalesce(F.min_by("l", F.struct(-F.col("n"), F.col("first"))), F.lit("en")).alias("language"))


@query(f"WITH {_SHELF} SELECT count(*) FILTER (percent > 0.02 OR minutes > 2) AS started, count(*) FILTER (done) AS finished, round(count(*) FILTER (done) / count(*) FILTER (percent > 0.02 OR minutes > 2), 6) AS completion_rate FROM wt")
def completion_rate(spark, sf_dir):
    rows = _shelf(spark, sf_dir)
    started, finished = F.count_if((F.col("percent") > T.STARTED) | (F.col("minutes") > T.STARTED_MINUTES)), F.count_if("done")
    return rows.agg(started.alias("started"), finished.alias("finished"), F.round(F.when(started > 0, finished / started), 6).alias("completion_rate"))


@query(f"""{_S}, now AS (SELECT book_id, sum(tn) / 10 AS minutes, coalesce(sum(tn) FILTER (mode = 'listen'), 0) / 10 AS listen FROM sess GROUP BY book_id),
sub AS (SELECT conv_id AS book_id, {sql.norm("string_agg(text, ' ' ORDER BY turn, role)")} AS s FROM conversations GROUP BY conv_id)
SELECT book_id, CASE WHEN minutes < 5 THEN 'Just getting started' ELSE CASE WHEN regexp_matches(s, 'fantasy|science fiction|adventure') THEN 'World-builder' WHEN regexp_matches(s, 'mystery|detective|crime|thriller') THEN 'Puzzle-solver'
 WHEN regexp_matches(s, 'history|biography|science|philosophy|essays|politics') THEN 'Deep-diver' WHEN regexp_matches(s, 'romance|love|domestic') THEN 'Heart-first reader' WHEN regexp_matches(s, 'poetry|drama|plays') THEN 'Language-lover'
 WHEN regexp_matches(s, 'children|fairy|juvenile|nonsense') THEN 'Wonder-seeker' ELSE 'Wide-ranging reader' END || CASE WHEN listen / minutes > 0.6 THEN ', mostly by ear' ELSE '' END END AS label FROM now JOIN sub USING (book_id)""")
def archetype(spark, sf_dir):
    """Labels of readers (book_id) whose conversation of the same number tells their subjects."""
    s = _sessions(spark, sf_dir).groupBy("book_id").agg(S.tenths().alias("minutes"), S.tenths(F.col("mode") == "listen").alias("listen"))
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("book_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: t["text"]), " ").alias("t"))
    rows = s.join(turns, "book_id")
    return rows.select("book_id", T.archetype(normalize(F.col("t")), F.col("listen") / F.col("minutes"), F.lit(0), F.lit(0), F.col("minutes")).alias("label"))


@query(f"""{_S}, {_STATS}, {sql.PARAS}, b AS (SELECT doc_id AS book_id, CAST(sum(pwc) AS BIGINT) AS words, count(DISTINCT c) AS chapters FROM paras GROUP BY doc_id),
lib AS (SELECT CASE WHEN sum(tn) / 10 >= 2 THEN CAST(floor(sum(words) / (sum(tn) / 10) + 0.5) AS BIGINT) END AS library_wpm FROM sess WHERE mode = 'read' AND words > 30 AND minutes >= 0.5),
med AS (SELECT list_sort(list(words))[count(*) // 2 + 1] AS median_words FROM b),
x AS (SELECT b.book_id, b.words, b.chapters, st.wpm, lib.library_wpm, med.median_words, coalesce(st.minutes, 0) AS minutes, coalesce(st.listen_minutes, 0) AS listen_minutes, least(1.0, coalesce(st.words, 0) / b.words) AS percent FROM b LEFT JOIN st USING (book_id), lib, med)
SELECT book_id, words, {sql.js_round('words / coalesce(wpm, library_wpm, 230) / 60', 3)} AS hours, {sql.js_round('words / greatest(1, chapters)')} AS avg_chapter_words,
 CASE WHEN words < 25000 THEN 'Novella-length' WHEN words < 60000 THEN 'Short novel' WHEN words < 110000 THEN 'Full-length novel' WHEN words < 200000 THEN 'Long read' ELSE 'Epic' END AS length_band,
 {sql.js_round('words / coalesce(nullif(median_words, 0), 90000)', 3)} AS length_ratio,
 CASE WHEN wpm IS NOT NULL AND library_wpm IS NOT NULL THEN CASE WHEN wpm > library_wpm * 1.1 THEN 'faster than your usual' WHEN wpm < library_wpm * 0.9 THEN 'slower than your usual' ELSE 'your usual pace' END END AS pace,
 {sql.js_round('CASE WHEN minutes > 0 THEN listen_minutes / minutes ELSE 0 END', 3)} AS listen_share, percent >= 0.98 AS finished FROM x""")
def reading_label(spark, sf_dir):
    from ..plans.ranks import upper_median_by_counts

    s = _sessions(spark, sf_dir)
    books = paragraphs(table(spark, sf_dir, "documents")).groupBy(F.col("doc_id").alias("book_id")).agg(F.sum("pwc").alias("words"), (F.max("c") + 1).alias("chapters"))
    library = s.agg(S.user_wpm(s).alias("library_wpm"))
    median = upper_median_by_counts(books.select(F.lit("all").alias("set"), "words"), "set", "words").select(F.col("median").alias("median_words"))
    stats = S.book_stats(s, ["book_id"]).select("book_id", "wpm", "minutes", "listen_minutes", F.col("words").alias("read"))
    rows = books.join(stats, "book_id", "left").join(F.broadcast(library)).join(F.broadcast(median))  # one row each
    percent = F.least(F.lit(1.0), F.coalesce("read", F.lit(0)) / F.col("words"))
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("minutes", "listen_minutes")]
    return T.label(rows.select("book_id", "words", "chapters", "wpm", "library_wpm", "median_words", *zero, percent.alias("percent"), F.lit(False).alias("finished")))
