"""Documents laid out on pages by rule, and read back: lines, paragraphs, chapters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import layout as L
from ..plans.corpus import paragraphs
from ..plans.shared import kept
from ..registry import query, table
from . import sql

_PART = [("  Part  one", 1, [("Section A", 2), ("", 3), ("Section B", 2)]), ("Part two", None, [("Section C", 4)])]


def _lines(spark, sf_dir):
    """(doc_id, page, r, first, piece, x, y, h): paragraphs in pieces of 70 characters, 30 a page; words that are cut have a hyphen."""
    paras = paragraphs(table(spark, sf_dir, "documents"))
    cuts = paras.select("doc_id", "c", "p", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 70).cast("int"))).alias("k"))
    raw = F.substr("text", F.col("k") * 70 + 1, F.lit(70))
    mid = raw.rlike("[A-Za-z]$") & F.substr("text", F.col("k") * 70 + 71, F.lit(1)).rlike("^[A-Za-z]")
    piece = F.trim(F.concat(raw, F.when(mid, "-").otherwise("")))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("c", "p", "k")) - 1
    rows = cuts.withColumns({"piece": piece, "n": at}).filter("piece != ''")
    heading = (F.col("k") == 0) & (F.col("p") == 0) & (F.col("doc_id") % 3 != 2)
    x = F.when((F.col("k") == 0) & (F.col("p") % 2 == 1), 65.0).otherwise(50.0)
    return rows.select("doc_id", (F.floor(F.col("n") / 30) + 1).cast("int").alias("page"), "piece", x.alias("x"), (F.lit(740.0) - 12 * (F.col("n") % 30)).alias("y"), F.when(heading, 14.0).otherwise(10.0).alias("h"))


def _items(spark, sf_dir):
    """Each line as its first word and the rest, one unit lower, and on each page a running head and the page's number."""
    lines = kept(_lines(spark, sf_dir), "laid-out")
    head, rest = F.regexp_extract("piece", r"^([^ ]+)", 1), F.regexp_extract("piece", r"^[^ ]+ +(.*)$", 1)
    item = lambda s, x, y: F.struct(s.alias("str"), x.alias("x"), y.alias("y"), F.col("h"), (5.0 * F.length(s)).alias("w"))
    both = F.filter(F.array(item(head, F.col("x"), F.col("y")), item(rest, F.col("x") + 5 * (F.length(head) + 1), F.col("y") - 1)), lambda t: t["str"] != "")
    pages = lines.select("doc_id", "page").distinct()
    text = pages.select("doc_id", "page", F.explode(F.array(F.struct(F.concat(F.lit("Running head "), "doc_id").alias("str"), F.lit(790.0).alias("y")), F.struct(F.col("page").cast("string").alias("str"), F.lit(20.0).alias("y")))).alias("t"))
    furniture = text.select("doc_id", "page", "t.str", F.lit(50.0).alias("x"), "t.y", F.lit(8.0).alias("h"), F.lit(60.0).alias("w"))
    return lines.select("doc_id", "page", F.inline(both)).unionByName(furniture), pages


_PAGES = f"""WITH {sql.PARAS}, cuts AS (SELECT doc_id, c, p, text, unnest(range(0, (length(text) - 1) // 70 + 1)) AS k FROM paras),
cut2 AS (SELECT doc_id, c, p, k, trim(substr(text, k * 70 + 1, 70) || CASE WHEN regexp_matches(substr(text, k * 70 + 1, 70), '[A-Za-z]$') AND regexp_matches(substr(text, k * 70 + 71, 1), '^[A-Za-z]') THEN '-' ELSE '' END, ' ') AS piece, row_number() OVER (PARTITION BY doc_id ORDER BY c, p, k) - 1 AS n FROM cuts),
laid AS (SELECT doc_id, CAST(n // 30 + 1 AS INTEGER) AS page, n % 30 AS r, piece, CASE WHEN k = 0 AND p % 2 = 1 THEN 65 ELSE 50 END AS x, 740 - 12 * (n % 30) AS y, CASE WHEN k = 0 AND p = 0 AND doc_id % 3 <> 2 THEN 14 ELSE 10 END AS h FROM cut2 WHERE piece <> ''),
tops AS (SELECT doc_id, page, -1 AS r, 'Running head ' || doc_id AS text, 50 AS x, 110 AS x_end, 790 AS y, 8 AS h FROM laid GROUP BY ALL), feet AS (SELECT doc_id, page, 99 AS r, CAST(page AS VARCHAR), 50, 110, 20, 8 FROM laid GROUP BY ALL),
ln AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY r) - 1 AS line, count(*) OVER (PARTITION BY doc_id, page) AS size FROM
  (SELECT doc_id, page, r, regexp_replace(piece, ' +', ' ', 'g') AS text, x, x + 5 * length(regexp_extract(piece, '^[^ ]+')) + CASE WHEN contains(piece, ' ') THEN 5 + 5 * length(regexp_extract(piece, '^[^ ]+ +(.*)$', 1)) ELSE 0 END AS x_end, y, h FROM laid UNION ALL SELECT * FROM tops UNION ALL SELECT * FROM feet))"""
_PARTS = f"""{_PAGES}, many AS (SELECT doc_id, count(DISTINCT page) AS pages FROM ln GROUP BY doc_id),
keyed AS (SELECT ln.*, pages, regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '[^\\p{{L}}#]', '', 'g') AS key, (line < 2 OR line >= size - 2) AND pages >= 3 AS edge FROM ln JOIN many USING (doc_id)),
rep AS (SELECT doc_id, key FROM keyed WHERE edge AND length(key) >= 2 GROUP BY doc_id, key, pages HAVING count(DISTINCT page) >= greatest(3, ceil(0.3 * pages))),
l2 AS (SELECT k.* FROM keyed k LEFT JOIN rep USING (doc_id, key) WHERE NOT (edge AND (rep.key IS NOT NULL OR regexp_matches(regexp_replace(text, '\\s', '', 'g'), '(?i)^[0-9ivxlc]{{1,6}}$')))),
body AS (SELECT doc_id, list_sort(list(h))[len(list(h)) // 2 + 1] AS body FROM l2 GROUP BY doc_id),
l3 AS (SELECT l2.*, body, h > 1.22 * body AND len(regexp_extract_all(text, '\\S+')) <= 14 AND NOT regexp_matches(text, '[,;:]$') AND NOT (regexp_matches(text, '[a-z]\\.$') AND len(regexp_extract_all(text, '\\S+')) > 8) AS heading,
  x_end - x AS width, x - min(x) OVER (PARTITION BY doc_id, page) AS inset, max(x_end - x) OVER (PARTITION BY doc_id, page) AS widest FROM l2 JOIN body USING (doc_id)),
l4 AS (SELECT *, CASE WHEN lag(line) OVER w IS NULL OR heading OR lag(heading) OVER w OR lag(y) OVER w - y > 1.7 * body OR (inset > 0.9 * body AND lag(inset) OVER w < 0.9 * body)
  OR (lag(width) OVER w < 0.75 * widest AND regexp_matches(lag(text) OVER w, '[.!?…"”’'')\\]]$')) THEN 1 ELSE 0 END AS new FROM l3 WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
l5 AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id, page ORDER BY line) AS BIGINT) AS block FROM l4),
glued AS (SELECT doc_id, page, block, any_value(heading) AS heading, string_agg(text, chr(10) ORDER BY line) AS t FROM l5 GROUP BY doc_id, page, block),
blocks AS (SELECT doc_id, page, block, heading, replace(regexp_replace(t, '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g'), chr(10), ' ') AS text FROM glued)"""
_CHAPTERS = f"""{_PARTS}, go AS (SELECT *, coalesce(NOT heading AND NOT lag(heading) OVER w AND NOT regexp_matches(lag(text) OVER w, '[.!?…"”’'')\\]:]$') AND regexp_matches(text, '^[a-z(“"‘'']') AND page = lag(page) OVER w + 1, false) AS carries FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY page, block)),
runs AS (SELECT *, sum(CASE WHEN carries THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page, block) AS run FROM go),
pairs AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY page, block) - 1) // 2 AS two FROM runs),
joined AS (SELECT doc_id, run, two, min(page) AS page, any_value(heading) AS heading, replace(regexp_replace(string_agg(text, chr(10) ORDER BY page, block), '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g'), chr(10), ' ') AS text FROM pairs GROUP BY doc_id, run, two),
bl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY run, two) AS ord FROM joined),
facts AS (SELECT doc_id, pages, CASE WHEN doc_id % 3 = 0 THEN 'outline' WHEN heads >= 2 AND heads <= greatest(6, 1.5 * pages) THEN 'headings' ELSE 'pages' END AS strategy FROM many LEFT JOIN (SELECT doc_id, count(*) FILTER (heading) AS heads FROM bl GROUP BY doc_id) USING (doc_id)),
ol AS (SELECT * FROM (VALUES (1, 'Part one'), (2, 'Section A'), (4, 'Section C')) t(start, title)),
o1 AS (SELECT bl.*, CAST(ol.start AS BIGINT) AS start, ol.title FROM bl JOIN facts USING (doc_id) ASOF JOIN ol ON bl.page >= ol.start WHERE strategy = 'outline'),
o2 AS (SELECT *, heading AND contains({sql.norm('title')}, {sql.norm('text')}) AS part FROM o1),
o3 AS (SELECT doc_id, ord, page, text, start, title FROM (SELECT *, coalesce(bool_and(part) OVER (PARTITION BY doc_id, start ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS head FROM o2) WHERE NOT (heading AND {sql.norm('title')} = {sql.norm('text')}) AND NOT (part AND head)),
h1 AS (SELECT bl.*, heading AND NOT coalesce(lag(heading) OVER (PARTITION BY doc_id ORDER BY ord), false) AS opens FROM bl JOIN facts USING (doc_id) WHERE strategy = 'headings'),
h2 AS (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS start FROM h1),
h3 AS (SELECT doc_id, start, string_agg(text, ' · ' ORDER BY ord) AS title FROM h2 WHERE heading GROUP BY ALL),
h4 AS (SELECT h2.doc_id, ord, page, text, start, coalesce(title, 'Front matter') AS title FROM h2 LEFT JOIN h3 USING (doc_id, start) WHERE NOT heading),
p1 AS (SELECT bl.doc_id, ord, page, text, CASE WHEN pages <= 40 THEN 0 ELSE (page - 1) // 20 END AS start, CASE WHEN pages <= 40 THEN 'Document ' || doc_id ELSE 'Pages ' || ((page - 1) // 20 * 20 + 1) || '–' || least(pages, ((page - 1) // 20 + 1) * 20) END AS title FROM bl JOIN facts USING (doc_id) WHERE strategy = 'pages'),
every AS (SELECT * FROM o3 UNION ALL SELECT * FROM h4 UNION ALL SELECT * FROM p1)"""


@query(f"{_PAGES} SELECT doc_id, page, CAST(line AS INTEGER) AS line, text, x, x_end, y, h FROM ln")
def page_lines(spark, sf_dir):
    """Lines from items whose parts stand a little lower than their beginnings."""
    return L.items_to_lines(_items(spark, sf_dir)[0]).select("doc_id", "page", "line", "text", *[F.col(c).cast("int").alias(c) for c in ("x", "x_end", "y", "h")])


@query(f"{_PARTS} SELECT doc_id, page, CAST(line AS INTEGER) AS line, text FROM l2")
def page_body(spark, sf_dir):
    """Lines without running heads and page numbers."""
    return L.strip_furniture(L.items_to_lines(_items(spark, sf_dir)[0])).select("doc_id", "page", "line", "text")


@query(f"{_PARTS} SELECT doc_id, page, block, text, heading FROM blocks")
def page_paragraphs(spark, sf_dir):
    return L.lines_to_paragraphs(L.strip_furniture(L.items_to_lines(_items(spark, sf_dir)[0]))).select("doc_id", "page", "block", "text", "heading")


@query(f"{_CHAPTERS} SELECT doc_id, strategy, dense_rank() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS c, title, row_number() OVER (PARTITION BY doc_id, start ORDER BY ord) - 1 AS p, page, text FROM every JOIN facts USING (doc_id)")
def page_chapters(spark, sf_dir):
    """Items to chapters in one plan: a third of the documents has an outline, a third headings."""
    items, pages = _items(spark, sf_dir)
    documents = pages.groupBy("doc_id").agg(F.count("*").alias("pages")).withColumn("title", F.concat(F.lit("Document "), "doc_id"))
    outline = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(p).cast("int").alias("page"), F.array(*[F.struct(F.lit(a).alias("title"), F.lit(b).alias("page")) for a, b in kids]).alias("items")) for t, p, kids in _PART])
    outlines = documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, outline).alias("items"))
    return L.read_pages(items, outlines, documents)
