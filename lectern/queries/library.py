"""Calibration, catalog and shelf. Orders are calibration points of their customer, parts are works."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.text import js_round, normalize
from ..operators import catalog as C
from ..operators import mapping as P
from ..registry import query, table
from . import sql

_POINTS = """pt AS (SELECT o_custkey AS book_id, CAST(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS BIGINT) + 1 AS page, arg_max(CAST(floor(o_totalprice / 100) AS BIGINT), o_orderkey) AS step FROM orders GROUP BY ALL),
points AS (SELECT book_id, page, CAST(sum(step) OVER (PARTITION BY book_id ORDER BY page) AS BIGINT) AS g FROM pt),
books AS (SELECT c_custkey AS book_id, coalesce(m, 50000) + 1000 AS total_words, CASE WHEN c_custkey % 2 = 0 THEN 400 END AS total_pages FROM customer LEFT JOIN (SELECT book_id, max(g) AS m FROM points GROUP BY 1) ON book_id = c_custkey),
ends AS (SELECT book_id, min({'page': page, 'g': g}) AS a, max({'page': page, 'g': g}) AS z, count(*) AS n FROM points GROUP BY 1),
facts AS (SELECT books.*, a, z, coalesce(n, 0) AS n, CASE WHEN n >= 2 AND z.page <> a.page AND z.g <> a.g THEN greatest(20.0, (z.g - a.g) / (z.page - a.page)) ELSE coalesce(CASE WHEN total_pages > 0 AND total_words > 0 THEN total_words / total_pages END, 280.0) END AS wpp FROM books LEFT JOIN ends USING (book_id)),
spans AS (SELECT * FROM (SELECT book_id, page AS p1, g AS g1, lead(page) OVER w AS page2, lead(g) OVER w AS g2 FROM points WINDOW w AS (PARTITION BY book_id ORDER BY page)) WHERE page2 IS NOT NULL),
asked AS (SELECT book_id, page + 5 AS page FROM points UNION SELECT book_id, page FROM points UNION SELECT book_id, 1 FROM books),
goal AS (SELECT book_id, g + 777 AS g FROM points UNION SELECT book_id, g FROM points UNION SELECT book_id, 1000 FROM books)"""


def _calibration(spark, sf_dir):
    """Points: an order's day is the page, running totals are offsets; the later of two orders of a day counts."""
    from pyspark.sql import Window

    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("long") + 1
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), day.alias("page"), F.floor(F.col("o_totalprice") / 100).alias("g"), F.col("o_orderkey").alias("at"))
    w = Window.partitionBy("book_id").orderBy("page")
    points = P.latest_points(rows).select("book_id", "page", F.sum("g").over(w).alias("g"))
    top = points.groupBy("book_id").agg(F.max("g").alias("m"))
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id")).join(top, "book_id", "left")
    return points, books.select("book_id", (F.coalesce("m", F.lit(50000)) + 1000).alias("total_words"), F.when(F.col("book_id") % 2 == 0, 400).alias("total_pages"))


@query(f"WITH {_POINTS} SELECT book_id, {sql.js_round('wpp', 3)} AS wpp, CASE WHEN n >= 2 THEN 'good' WHEN n = 1 THEN 'rough' WHEN total_pages > 0 THEN 'estimate' ELSE 'none' END AS quality FROM facts")
def words_per_page(spark, sf_dir):
    facts = P.book_facts(*_calibration(spark, sf_dir))
    return facts.select("book_id", js_round(F.col("wpp"), 3).alias("wpp"), P.quality(F.col("n"), F.col("total_pages")).alias("quality"))


@query(f"""WITH {_POINTS} SELECT q.book_id, q.page, CASE WHEN n > 0 OR total_pages > 0 THEN CAST(greatest(0, least(floor(CASE WHEN n = 0 THEN CASE WHEN total_pages > 0 THEN (q.page - 1) * wpp END WHEN q.page <= a.page THEN a.g - (a.page - q.page) * wpp
WHEN q.page >= z.page THEN z.g + (q.page - z.page) * wpp ELSE s.g1 + (q.page - s.p1) / (s.page2 - s.p1) * (s.g2 - s.g1) END + 0.5), total_words)) AS BIGINT) END AS g
FROM asked q ASOF LEFT JOIN spans s ON q.book_id = s.book_id AND q.page >= s.p1 JOIN facts f ON f.book_id = q.book_id""")
def pages_to_global(spark, sf_dir):
    points, books = _calibration(spark, sf_dir)
    asked = points.select("book_id", F.col("page") + 5).union(points.select("book_id", "page")).union(books.select("book_id", F.lit(1).cast("long"))).toDF("book_id", "page").distinct()
    return P.page_to_global(asked, points, books)


@query(f"""WITH {_POINTS} SELECT q.book_id, q.g, CAST(CASE WHEN n = 0 THEN CASE WHEN total_pages > 0 THEN greatest(1, floor(q.g / wpp) + 1) END WHEN q.g <= a.g THEN greatest(1, floor(a.page - (a.g - q.g) / wpp + 0.5))
WHEN q.g >= z.g THEN floor(z.page + (q.g - z.g) / wpp + 0.5) ELSE floor(s.p1 + CASE WHEN s.g2 = s.g1 THEN 0.0 ELSE (q.g - s.g1) / (s.g2 - s.g1) END * (s.page2 - s.p1) + 0.5) END AS BIGINT) AS page
FROM goal q ASOF LEFT JOIN spans s ON q.book_id = s.book_id AND q.g >= s.g1 JOIN facts f ON f.book_id = q.book_id""")
def global_to_page(spark, sf_dir):
    points, books = _calibration(spark, sf_dir)
    asked = points.select("book_id", F.col("g") + 777).union(points.select("book_id", "g")).union(books.select("book_id", F.lit(1000).cast("long"))).toDF("book_id", "g").distinct()
    return P.global_to_page(asked, points, books)


_AUTHORS = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || ', ' || p_brand || ', 1775-1817' WHEN 1 THEN p_brand || ', ed.' WHEN 2 THEN p_name || ' (1901-)' WHEN 3 THEN p_brand || ', ' || p_name ELSE p_name END AS raw FROM part"


@query(f"""WITH a AS ({_AUTHORS}), s AS (SELECT p_partkey, raw, trim(regexp_replace(regexp_replace(raw, '(?i),\\s*(ed|editor|ill|illustrator|tr|translator|comp|compiler)\\.?$', ''), ',?\\s*\\(?\\b[0-9]{{3,4}}-([0-9]{{3,4}})?\\)?\\.?$', '')) AS s FROM a)
SELECT p_partkey, raw, CASE WHEN regexp_matches(s, '^([^,]+),\\s*([^,]+)$') THEN trim(regexp_extract(s, '^([^,]+),\\s*([^,]+)$', 2)) || ' ' || trim(regexp_extract(s, '^([^,]+),\\s*([^,]+)$', 1)) ELSE s END AS author FROM s""")
def clean_author(spark, sf_dir):
    k, name, brand = F.col("p_partkey") % 5, F.col("p_name"), F.col("p_brand")
    raw = F.when(k == 0, F.concat_ws(", ", name, brand, F.lit("1775-1817"))).when(k == 1, F.concat(brand, F.lit(", ed."))).when(k == 2, F.concat(name, F.lit(" (1901-)"))).when(k == 3, F.concat_ws(", ", brand, name)).otherwise(name)
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", "raw", X.clean_author(F.col("raw")).alias("author"))


_RAW_SUBJECTS = "SELECT p_partkey, [p_name || '; ' || p_type || ' -- ' || p_brand, lower(p_type) || ', fiction', 'In library', 'Printed ' || (1900 + p_size), split_part(p_name, ' ', 1)] AS raw FROM part"


@query(f"""WITH r AS ({_RAW_SUBJECTS}), u AS (SELECT p_partkey, unnest(list_transform(flatten(list_transform(raw, lambda s: regexp_split_to_array(s, ';|,'))), lambda s: trim(regexp_replace(regexp_split_to_array(s, '\\s*--\\s*')[1], '\\s+', ' ', 'g')))) AS s, generate_subscripts(flatten(list_transform(raw, lambda s: regexp_split_to_array(s, ';|,'))), 1) AS i FROM r),
k AS (SELECT * FROM u WHERE s <> '' AND length(s) <= 40 AND NOT regexp_matches(s, '(?i){X.SUBJECT_STOP}') AND NOT regexp_matches(s, '[0-9]{{4}}')),
t AS (SELECT p_partkey, i, array_to_string(list_transform(string_split(lower(s), ' '), lambda w: regexp_extract(w, '^([^A-Za-z0-9_]*)([A-Za-z0-9_]?)(.*)$', 1) || upper(regexp_extract(w, '^([^A-Za-z0-9_]*)([A-Za-z0-9_]?)(.*)$', 2)) || regexp_extract(w, '^([^A-Za-z0-9_]*)([A-Za-z0-9_]?)(.*)$', 3)), ' ') AS s FROM k),
d AS (SELECT p_partkey, {sql.norm('s')} AS key, arg_min(s, i) AS s, min(i) AS i FROM t GROUP BY ALL)
SELECT p_partkey, array_to_string(list(s ORDER BY i)[1:12], '|') AS subjects FROM d GROUP BY p_partkey""")
def clean_subjects(spark, sf_dir):
    raw = F.array(F.concat("p_name", F.lit("; "), "p_type", F.lit(" -- "), "p_brand"), F.concat(F.lower("p_type"), F.lit(", fiction")), F.lit("In library"), F.concat(F.lit("Printed "), (1900 + F.col("p_size")).cast("string")), F.split("p_name", " ")[0])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.clean_subjects(raw), "|").alias("subjects"))


_CATALOG = """cat AS (SELECT 'works' AS source, p_partkey AS id, p_name AS title, p_brand AS author, CAST(p_size AS DOUBLE) AS rating, CAST(NULL AS VARCHAR) AS place, p_size % 2 = 0 AS full_text FROM part
UNION ALL SELECT 'people', c_custkey, c_name, NULL, NULL, c_mktsegment, false FROM customer UNION ALL SELECT 'makers', s_suppkey, s_name, NULL, NULL, CAST(s_nationkey AS VARCHAR), false FROM supplier)"""


def _catalog(spark, sf_dir):
    """Three sources with different columns as one table; earlier sources win over later ones."""
    works = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.col("p_size").cast("double").alias("rating"), (F.col("p_size") % 2 == 0).alias("full_text"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("place"))
    makers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_nationkey").cast("string").alias("place"))
    return C.union({"works": works, "people": people, "makers": makers})


@query(f"WITH {_CATALOG} SELECT source, id, title, author, rating, place, full_text FROM cat")
def catalog_union(spark, sf_dir):
    return _catalog(spark, sf_dir).select("source", "id", "title", "author", "rating", "place", "full_text")


@query(f"""WITH {_CATALOG}, k AS (SELECT *, {sql.norm('title')} || '|' || {sql.norm("regexp_split_to_array(coalesce(author, ''), ',|&| and ')[1]")} AS key, CASE source WHEN 'works' THEN 0 WHEN 'people' THEN 1 ELSE 2 END AS pr FROM cat),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pr, id) AS rn FROM k) SELECT source, id, title, full_text FROM r WHERE rn = 1 OR full_text""")
def search_dedup(spark, sf_dir):
    return C.dedup(_catalog(spark, sf_dir), ["works", "people", "makers"]).select("source", "id", "title", "full_text")


@query(f"WITH owned AS (SELECT DISTINCT {sql.norm('p_name')} AS t FROM part WHERE p_size > 45) SELECT p_partkey, p_name FROM part WHERE {sql.norm('p_name')} NOT IN (SELECT t FROM owned)")
def owned_anti(spark, sf_dir):
    works = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", normalize(F.col("p_name")).alias("t"))
    return works.join(works.filter("p_size > 45").select("t").distinct(), "t", "left_anti").select("p_partkey", "p_name")


_REC = f"""q AS (SELECT l_partkey AS k, sum(l_quantity) AS minutes FROM lineitem GROUP BY 1),
shelf AS (SELECT p_partkey AS id, p_name || ' ' || p_partkey AS title, p_brand AS author, p_type AS subject, 3 + p_size % 20 / 10 AS rating, CAST(floor(p_retailprice / 4) AS BIGINT) AS pages, p_size % 2 = 0 AS full_text, least(1.0, coalesce(minutes, 0) / (p_size * 40.0)) AS percent, coalesce(minutes, 0) AS minutes FROM part LEFT JOIN q ON k = p_partkey),
wt AS (SELECT *, 0.25 + 0.75 * percent + CASE WHEN percent >= 0.98 THEN 0.6 ELSE 0 END + least(1.0, minutes / 120) * 0.6 AS w FROM shelf),
su AS (SELECT {sql.norm('subject')} AS key, round(sum(w), 6) AS weight, min(id) AS ord FROM wt GROUP BY 1 ORDER BY weight DESC, ord LIMIT 8), sw AS (SELECT key, ord, {sql.js_round('weight / max(weight) OVER ()', 2)} AS weight FROM su),
seeds AS (SELECT key, 0.6 + weight AS w FROM sw ORDER BY weight DESC, ord LIMIT 4),
au AS (SELECT {sql.norm('author')} AS key, round(sum(w), 6) AS weight, min(id) AS ord FROM wt GROUP BY 1 ORDER BY weight DESC, ord LIMIT 2),
owned AS (SELECT DISTINCT {sql.norm('title')} AS t, {sql.norm('author')} AS a FROM shelf WHERE percent > 0.9),
pref AS (SELECT list_sort(list(pages))[count(*) // 2 + 1] AS p FROM shelf WHERE percent >= 0.98),
c AS (SELECT s.*, seeds.w AS sw, CASE WHEN au.key IS NOT NULL THEN 1.1 END AS aw, sw.key IS NOT NULL AS overlap FROM shelf s LEFT JOIN seeds ON seeds.key = {sql.norm('s.subject')} LEFT JOIN au ON au.key = {sql.norm('s.author')} LEFT JOIN sw ON sw.key = {sql.norm('s.subject')}
  WHERE (seeds.key IS NOT NULL OR au.key IS NOT NULL) AND {sql.norm('s.title')} NOT IN (SELECT t FROM owned)),
sc AS (SELECT id, title, coalesce(sw, 0) + coalesce(aw, 0) + CASE WHEN overlap THEN 0.3 ELSE 0 END + CASE WHEN full_text THEN 0.7 ELSE 0 END + (rating - 3.6) * 0.5 + CASE WHEN pages / p > 0.6 AND pages / p < 1.6 THEN 0.25 ELSE 0 END
  + CASE WHEN aw IS NULL AND {sql.norm('author')} IN (SELECT a FROM owned) THEN 0.3 ELSE 0 END AS score FROM c, pref)"""


@query(f"WITH {_REC} SELECT id, title, {sql.js_round('round(score, 9)', 2)} AS score FROM sc ORDER BY {sql.js_round('round(score, 9)', 2)} DESC, id LIMIT 12")
def recommend(spark, sf_dir):
    from ..operators import taste as T

    minutes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("minutes"))
    shelf = table(spark, sf_dir, "part").join(minutes, "p_partkey", "left").withColumn("minutes", F.coalesce("minutes", F.lit(0.0)))
    shelf = shelf.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_partkey").alias("title"), F.col("p_brand").alias("author"), F.array("p_type").alias("subjects"), (3 + F.col("p_size") % 20 / 10).alias("rating"), F.floor(F.col("p_retailprice") / 4).alias("pages"), (F.col("p_size") % 2 == 0).alias("full_text"), F.least(F.lit(1.0), F.col("minutes") / (F.col("p_size") * 40.0)).alias("percent"), "minutes")
    weighed = shelf.withColumn("w", T.weight(F.col("percent"), F.col("percent") >= T.DONE, F.col("minutes")))
    subjects = T.taste(weighed.select(F.col("subjects")[0].alias("name"), "w", F.col("id").alias("ord")), 8, True)
    authors = T.taste(weighed.select(F.col("author").alias("name"), "w", F.col("id").alias("ord")), 2, False)
    done = shelf.filter(F.col("percent") >= T.DONE)
    return C.recommend(shelf.drop("percent", "minutes"), subjects, authors, shelf.filter("percent > 0.9"), done).select("id", "title", "score")


@query("""SELECT o_orderkey, CASE WHEN n >= 1e6 THEN regexp_replace(printf('%.1f', n / 1e6), '\\.0$', '') || 'M' WHEN n >= 1e4 THEN CAST(floor(n / 1e3 + 0.5) AS BIGINT) || 'k' WHEN n >= 1e3 THEN regexp_replace(printf('%.1f', n / 1e3), '\\.0$', '') || 'k' ELSE CAST(CAST(floor(n + 0.5) AS BIGINT) AS VARCHAR) END AS label
FROM (SELECT o_orderkey, o_totalprice * (1 + o_orderkey % 40) / (1 + o_orderkey % 7 * 100) AS n FROM orders)""")
def fmt_compact(spark, sf_dir):
    n = F.col("o_totalprice") * (1 + F.col("o_orderkey") % 40) / (1 + F.col("o_orderkey") % 7 * 100)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.fmt_compact(n).alias("label"))


@query("""WITH e AS (SELECT event_id, floor((now - epoch_us(ts)) / 60000000 + 0.5) AS m FROM events, (SELECT max(epoch_us(ts)) AS now FROM events)), h AS (SELECT *, floor(m / 60 + 0.5) AS h FROM e), d AS (SELECT *, floor(h / 24 + 0.5) AS d FROM h)
SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN CAST(m AS BIGINT) || ' min ago' WHEN h < 24 THEN CAST(h AS BIGINT) || 'h ago' WHEN d = 1 THEN 'yesterday' WHEN d < 30 THEN CAST(d AS BIGINT) || ' days ago' END AS ago FROM d""")
def rel_time(spark, sf_dir):
    from ..operators.sessions import micros

    events = table(spark, sf_dir, "events").select("event_id", micros(F.col("ts")).alias("us"))
    now = events.agg(F.max("us").alias("now"))
    return events.join(F.broadcast(now)).select("event_id", X.rel_time(F.col("us"), F.col("now")).alias("ago"))  # one row


@query("""SELECT o_orderkey, CASE WHEN s // 3600 > 0 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s % 3600 // 60 > 0 THEN (s % 3600 // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS duration,
CASE WHEN m < 60 THEN m || ' min' WHEN m % 60 = 0 THEN (m // 60) || 'h' ELSE (m // 60) || 'h ' || (m % 60) || 'm' END AS minutes FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 40 + 0.5) AS BIGINT) AS s, CAST(floor(o_totalprice / 500 + 0.5) AS BIGINT) AS m FROM orders)""")
def format_times(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.format_duration(F.col("o_totalprice") / 40).alias("duration"), X.format_minutes(F.col("o_totalprice") / 500).alias("minutes"))


@query("""WITH n AS (SELECT p_partkey, split_part(p_name, ' ', 1) || p_partkey % 120 || '_' || p_size || '.jpg' AS name FROM part), t AS (SELECT *, regexp_extract_all(lower(name), '[0-9]+|[^0-9]+') AS l FROM n),
k AS (SELECT p_partkey, name, array_to_string(list_transform(l, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN lpad(x, 12, '0') ELSE x END), '') AS key FROM t)
SELECT p_partkey, name, row_number() OVER (ORDER BY key, p_partkey) AS place FROM k""")
def natural_sort(spark, sf_dir):
    """Places in natural order, numbered from a range-partitioned sort: no task sees more than its range."""
    from ..plans.ranks import global_places

    name = F.concat(F.split("p_name", " ")[0], (F.col("p_partkey") % 120).cast("string"), F.lit("_"), F.col("p_size").cast("string"), F.lit(".jpg"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("key", X.natural_key(F.col("name")))
    return global_places(rows, ["key", "p_partkey"]).select("p_partkey", "name", "place")
