"""Scans of the store and small decisions, over the star tables and the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import js_round
from ..operators import catalog as C
from ..operators import choices as H
from ..operators import locators as L
from ..operators import mapping as P
from ..operators import narration as N
from ..operators.sessions import micros
from ..plans.corpus import paragraphs
from ..plans.shared import kept
from ..registry import query, table
from . import library, narration, positions, sql
from .library import _calibration


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_partkey = 17")
def point_get(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_partkey = 17").select("p_partkey", "p_name", "p_type")


@query("SELECT c_custkey FROM customer")
def key_scan(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 5")
def index_scan(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_custkey = 5").select("o_orderkey", "o_orderdate")


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS store, count(*) AS n FROM {t}" for t in _TABLES))
def store_counts(spark, sf_dir):
    from functools import reduce

    parts = [spark.read.parquet(f"{sf_dir}/{t}.parquet").agg(F.count("*").alias("n")).select(F.lit(t).alias("store"), "n") for t in _TABLES]
    return reduce(lambda a, b: a.union(b), parts)


@query("SELECT c_custkey, max(o_orderdate) AS last_opened FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY coalesce(max(o_orderdate), TIMESTAMP '1990-01-01') DESC, c_custkey LIMIT 20")
def recently_opened(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_opened"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left")
    return rows.orderBy(F.coalesce("last_opened", F.lit("1990-01-01").cast("timestamp_ntz")).desc(), "c_custkey").limit(20)


@query("""WITH f AS (SELECT l_orderkey AS item, l_partkey || '-' || l_linenumber AS name, CASE l_returnflag WHEN 'A' THEN 'txt' WHEN 'N' THEN 'epub' ELSE 'djvu' END AS kind, l_extendedprice AS bytes FROM lineitem),
r AS (SELECT *, CASE WHEN kind = 'txt' AND bytes > 2000 THEN 0 WHEN kind = 'epub' THEN 1 WHEN kind = 'djvu' THEN 2 END AS p FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY p, CASE WHEN p = 0 THEN -bytes ELSE 0 END, name) AS rn FROM r WHERE p IS NOT NULL)
SELECT item, name, kind FROM k WHERE rn = 1""")
def archive_file(spark, sf_dir):
    flag = F.col("l_returnflag")
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.concat_ws("-", "l_partkey", "l_linenumber").alias("name"), F.when(flag == "A", "txt").when(flag == "N", "epub").otherwise("djvu").alias("kind"), F.col("l_extendedprice").alias("bytes"))
    return H.best_file(files, "item")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'full text' WHEN p_type = 'PROMO' THEN 'download' WHEN p_type IN ('SMALL', 'LARGE') THEN 'borrow' ELSE 'look up' END AS label FROM part")
def availability_label(spark, sf_dir):
    access = F.when(F.col("p_type") == "PROMO", "public").when(F.col("p_type") == "SMALL", "borrowable").when(F.col("p_type") == "LARGE", "printdisabled")
    return table(spark, sf_dir, "part").select("p_partkey", H.availability(F.col("p_size") % 2 == 0, F.coalesce(access, F.lit(""))).alias("label"))


_GRADES = list(H.GRADES)


@query(f"WITH g AS (SELECT s_suppkey, s_nationkey, {_GRADES!r}[1 + s_suppkey % {len(_GRADES)}] AS grade FROM supplier) SELECT s_nationkey, count(*) AS voices FROM g WHERE grade IN ('A', 'A-', 'B+', 'B', 'B-', 'C+', 'C') GROUP BY s_nationkey")
def graded_voices(spark, sf_dir):
    """Voices of grade C or better, by language."""
    grade = F.element_at(F.array(*[F.lit(g) for g in _GRADES]), (F.col("s_suppkey") % len(_GRADES) + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").filter(H.grade_rank(grade) >= H.GRADES["C"])
    return rows.groupBy("s_nationkey").agg(F.count("*").alias("voices"))


@query(f"""WITH {sql.PARAS}, x AS (SELECT doc_id, c, list(text ORDER BY p) AS x FROM paras GROUP BY doc_id, c), l AS (SELECT doc_id, c, x || [CAST(c + 7 AS VARCHAR)] AS l FROM x), e AS (SELECT *, list_filter(CASE WHEN len(l) <= 6 THEN l ELSE l[1:3] || l[len(l) - 2:len(l)] END, lambda x: regexp_matches(x, '^\\s*[0-9]{{1,4}}\\s*$')) AS a FROM l)
SELECT doc_id, c, CASE WHEN len(a) > 0 THEN CAST(trim(a[1]) AS INTEGER) ELSE CAST(nullif(regexp_extract(l[1], '\\s([0-9]{{1,4}})\\s*$', 1), '') AS INTEGER) END AS page FROM e""")
def page_number_guess(spark, sf_dir):
    """Chapters as recognised pages with a number below the text."""
    rows = paragraphs(table(spark, sf_dir, "documents")).groupBy("doc_id", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "text"))), lambda t: t["text"]).alias("l"))
    return rows.select("doc_id", "c", H.page_number(F.concat("l", F.array((F.col("c") + 7).cast("string")))).alias("page"))


@query("WITH d AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') SELECT p_brand, count(*) AS needed, count(l_partkey) AS have, bool_and(l_partkey IS NOT NULL) AS all_ready, bool_or(l_partkey IS NOT NULL) AS any_ready FROM part LEFT JOIN d ON l_partkey = p_partkey GROUP BY p_brand")
def readiness_check(spark, sf_dir):
    present = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return H.readiness(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), present, "p_brand", "p_partkey")


@query(f"WITH u AS (SELECT user_id, CAST(sum(floor(coalesce(value, 0))) AS BIGINT) AS used FROM events GROUP BY user_id) SELECT user_id, used, {sql.js_round('least(1.0, used / 3000) * 100')} AS percent, greatest(0, 3000 - used) AS chars_left, {sql.js_round('greatest(0, 3000 - used) / 15 / 60', 1)} AS minutes FROM u")
def allowance_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.floor(F.coalesce("value", F.lit(0.0)))).alias("used"))
    percent, left, minutes = H.allowance(F.col("used"), F.lit(3000))
    return rows.select("user_id", "used", percent.alias("percent"), left.alias("chars_left"), minutes.alias("minutes"))


@query("SELECT user_id, epoch_us(ts) // 86400000000 AS slot, arg_max(value, {'u': epoch_us(ts), 'e': event_id}) AS value, count(*) AS events FROM events WHERE value IS NOT NULL GROUP BY ALL")
def debounce(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("value is not null").select("user_id", "event_id", micros(F.col("ts")).alias("us"), "value")
    return H.last_of_window(rows, ["user_id"], "us", "value", 86_400_000_000)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, greatest(0.0, least(100.0, coalesce(value, 0) + 5)) AS stepped FROM events")
def json_settings(spark, sf_dir):
    """A nested value by an explicit schema, and a bounded step of a setting."""
    from ..operators.store import step_setting

    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), step_setting(F.col("value"), F.lit(5), 0.0, 100.0).alias("stepped"))


@query("SELECT o_custkey, o_orderdate, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def outline_first(spark, sf_dir):
    """The first entry of each page of an outline: orders of a day."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("o_orderkey"))


@query(f"""WITH {library._POINTS}, g AS (SELECT book_id, max(page) AS page FROM points GROUP BY 1) SELECT f.book_id, g.page, {sql.js_round('least(1.0, z.g / total_words)', 4)} AS percent FROM g JOIN facts f USING (book_id)""")
def check_in(spark, sf_dir):
    """Progress from the last calibrated page of each book."""
    points, books = _calibration(spark, sf_dir)
    last = points.groupBy("book_id").agg(F.max("page").alias("page"))
    found = P.page_to_global(last, points, books).join(books.select("book_id", "total_words"), "book_id")
    return found.select("book_id", "page", js_round(F.least(F.lit(1.0), F.col("g") / F.col("total_words")), 4).alias("percent"))


@query("""WITH f AS (SELECT l_partkey AS book_id, arg_min(s_name, {'a': -l_quantity, 'b': l_orderkey, 'c': l_linenumber}) AS maker FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
SELECT p_partkey AS book_id, CASE WHEN p_size % 5 = 0 THEN 'photo' ELSE 'upload' END AS source, CASE WHEN p_size % 2 = 0 THEN p_brand WHEN p_size % 5 = 0 THEN NULL ELSE maker END AS author FROM part LEFT JOIN f ON book_id = p_partkey""")
def enrich_books(spark, sf_dir):
    """Authors that are missing come from the first match; books from photos are left alone."""
    books = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book_id"), F.when(F.col("p_size") % 5 == 0, "photo").otherwise("upload").alias("source"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("author"))
    makers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("author"))
    found = table(spark, sf_dir, "lineitem").join(makers, "l_suppkey").select(F.col("l_partkey").alias("book_id"), "author", F.struct((-F.col("l_quantity")).alias("a"), "l_orderkey", "l_linenumber").alias("rank"))
    return C.enrich(books, found, ["author"])


def _placed(spark, sf_dir):
    return L.sentence_offsets(paragraphs(table(spark, sf_dir, "documents")))


@query(f"""{positions._PLACED}, k AS (SELECT doc_id, c, p, s, c || '.' || p || '.' || s AS loc FROM placed)
SELECT doc_id, loc, coalesce(lag(loc, 3) OVER w, first_value(loc) OVER a) AS back, coalesce(lead(loc, 3) OVER w, last_value(loc) OVER a) AS ahead FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY c, p, s), a AS (PARTITION BY doc_id ORDER BY c, p, s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def skip_sentences(spark, sf_dir):
    return H.skip(_placed(spark, sf_dir), 3)


@query(f"""{positions._PLACED}, m AS (SELECT doc_id, max(c) AS mc FROM placed GROUP BY 1), mp AS (SELECT doc_id, c, max(p) AS mp FROM placed GROUP BY ALL), ms AS (SELECT doc_id, c, p, max(s) AS ms FROM placed GROUP BY ALL),
l AS (SELECT doc_id, c || '.' || p AS at, c + 1 AS c, p + 3 AS p FROM offs), a AS (SELECT l.doc_id, l.at, least(l.c, mc) AS c, l.p FROM l JOIN m USING (doc_id)), b AS (SELECT a.doc_id, a.at, a.c, least(a.p, mp) AS p FROM a JOIN mp USING (doc_id, c)), d AS (SELECT b.*, least(2, ms) AS s FROM b JOIN ms USING (doc_id, c, p))
SELECT d.doc_id, d.at, d.c, d.p, d.s, greatest(0, least(4, n_words - 1)) AS w FROM d JOIN placed USING (doc_id, c, p, s)""")
def clamp_locators(spark, sf_dir):
    """Positions three paragraphs down in the next chapter, third sentence, fifth word."""
    placed = kept(_placed(spark, sf_dir).select("doc_id", "c", "p", "s", "n_words"), "placed")  # read three times
    locs = paragraphs(table(spark, sf_dir, "documents")).select("doc_id", F.concat_ws(".", "c", "p").alias("at"), (F.col("c") + 1).alias("c"), (F.col("p") + 3).alias("p"), F.lit(2).alias("s"), F.lit(4).alias("w"))
    return H.clamp_locator(locs, placed)


@query(narration._fold("unit", "chars + 1 + {x} <= 700", "{x}", "chars + 1 + {x}").replace("SELECT doc_id, c, p, CAST(u AS INTEGER) AS unit", "SELECT doc_id, c, p, unit, lead(c || '.' || p || '.' || s_start) OVER (PARTITION BY doc_id ORDER BY c, p, unit) AS next FROM (SELECT doc_id, c, p, CAST(u AS INTEGER) AS unit") + ")")
def next_units(spark, sf_dir):
    return H.next_unit(N.units(paragraphs(table(spark, sf_dir, "documents")), N.UNIT_CHARS["multilingual"]))


@query(f"""WITH {sql.PARAS}, k AS (SELECT doc_id, c, p, text, length(text) < 60 AND regexp_matches(text, '[A-Z]{{3}}') AND NOT regexp_matches(text, '\\p{{Ll}}') AS head FROM paras WHERE NOT regexp_matches(trim(text), '^[0-9]{{1,4}}$')),
a AS (SELECT *, lag(text) OVER w AS after, coalesce(lag(head) OVER w, false) AS after_head FROM k WINDOW w AS (PARTITION BY doc_id, c ORDER BY p)),
i AS (SELECT *, sum(CASE WHEN after IS NULL OR head OR after_head OR regexp_matches(after, '[.!?…"”’]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, c ORDER BY p) AS para FROM a),
t AS (SELECT doc_id, c, CAST(para AS INTEGER) AS para, replace(regexp_replace(string_agg(text, chr(10) ORDER BY p), '(\\p{{Ll}})-\\n(\\p{{Ll}})', '\\1\\2', 'g'), chr(10), ' ') AS text FROM i GROUP BY doc_id, c, para) SELECT * FROM t WHERE len(regexp_extract_all(text, '\\S+')) >= 2""")
def ocr_paragraphs(spark, sf_dir):
    rows = paragraphs(table(spark, sf_dir, "documents")).select("doc_id", "c", F.col("p").alias("line"), "text")
    return H.ocr_paragraphs(rows, ["doc_id", "c"])
