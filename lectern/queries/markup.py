"""Pages as HTML imports, conversations as block lists, documents as plain text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import markup as M
from ..plans.corpus import paragraphs
from ..registry import query, table
from . import sql


def _decode(x: str) -> str:
    for name, char in M.ENTITIES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def _chain() -> str:
    h = "regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<head\\b.*?</head\\s*>', '', 'g')"
    for tag in M.DROPPED:
        h = f"regexp_replace({h}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    h = f"regexp_replace({h}, '(?i)<br\\b[^>]*>', chr(3), 'g')"
    h = f"regexp_replace({h}, '(?i)<h([1-6])\\b[^>]*>', chr(1) || chr(2) || '\\1', 'g')"
    h = f"regexp_replace({h}, '(?i)</?(?:h[1-6]|{'|'.join(M.BLOCKS)})\\b[^>]*>', chr(1), 'g')"
    return f"regexp_replace({_decode(f'regexp_replace({h}, ' + chr(39) + '<[^>]*>' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}, '[\\s ]+', ' ', 'g')"


_BLOCKS = f"""WITH sp AS (SELECT page_id, unnest(x) AS t, generate_subscripts(x, 1) - 1 AS i FROM (SELECT page_id, string_split({_chain()}, chr(1)) AS x FROM pages)),
lv AS (SELECT page_id, i, CASE WHEN t[1] = chr(2) THEN CAST(t[2] AS INTEGER) ELSE 0 END AS level, CASE WHEN t[1] = chr(2) THEN replace(t[3:], chr(3), '') ELSE replace(t, chr(3), chr(10)) END AS body FROM sp),
blocks AS (SELECT page_id, i, level, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '[ \\t]*\\n[ \\t]*', chr(10), 'g'), ' {{2,}}', ' ', 'g'), '\\n{{2,}}', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g') AS text FROM lv),
kept AS (SELECT * FROM blocks WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]'))"""

_TITLE = f"trim(regexp_replace({_decode(chr(34) + 't' + chr(34))}, '[\\s ]+', ' ', 'g'))"
_TITLES = f"titles AS (SELECT page_id, {_TITLE} AS title, author, language FROM (SELECT page_id, regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title', 1) AS \"t\", regexp_extract(coalesce(html, ''), '(?i)<meta\\s+name=[\"'']author[\"'']\\s+content=[\"'']([^\"'']*)', 1) AS author, regexp_extract(coalesce(html, ''), '(?i)<html\\b[^>]*?\\blang=[\"'']([^\"'']*)', 1)[1:5] AS language FROM pages))"


def _chapters(source: str, by: str, fallback: str) -> str:
    return f"""isl AS (SELECT *, CAST(sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY i) AS BIGINT) AS isl FROM {source}),
chs AS (SELECT {by}, isl, max(text) FILTER (heading) AS title, count(*) FILTER (NOT heading) AS n, sum(len(regexp_extract_all(text, '\\S+'))) FILTER (NOT heading) AS w FROM isl GROUP BY ALL),
run AS (SELECT *, CAST(coalesce(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY isl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS k FROM chs),
done AS (SELECT {by}, k, coalesce(string_agg(title, ' · ' ORDER BY isl), '') AS title, CAST(sum(n) AS BIGINT) AS paragraphs, CAST(sum(w) AS BIGINT) AS words FROM run GROUP BY ALL HAVING sum(n) > 0)
SELECT {by}, k AS idx, CASE WHEN done.title <> '' THEN done.title WHEN k = 0 THEN {fallback} ELSE 'Section ' || (k + 1) END AS title, paragraphs, words FROM done"""


@query(f"{_BLOCKS} SELECT page_id, CAST(i AS INTEGER) AS i, level, text FROM kept")
def html_blocks(spark, sf_dir):
    return M.html_blocks(table(spark, sf_dir, "pages"))


@query(f"WITH {_TITLES} SELECT page_id, title, author, language FROM titles")
def html_title_lang(spark, sf_dir):
    return M.title_lang(table(spark, sf_dir, "pages"))


@query(f"{_BLOCKS}, hb AS (SELECT page_id, i, level BETWEEN 1 AND 2 AS heading, text FROM kept), {_chapters('hb', 'page_id', chr(39) + 'Section 1' + chr(39))}")
def html_chapters(spark, sf_dir):
    blocks = M.html_blocks(table(spark, sf_dir, "pages"))
    return M.chapters(blocks.select("page_id", "i", F.col("level").between(1, 2).alias("heading"), "text"), "page_id")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", M.strip_tags(F.col("html")).alias("plain"))


@query(f"WITH hb AS (SELECT conv_id, turn AS i, role = 'system' OR turn % 5 = 4 AS heading, text FROM conversations), {_chapters('hb', 'conv_id', chr(39) + 'Section 1' + chr(39))}")
def chapters_from_blocks(spark, sf_dir):
    """System turns and every fifth turn play headings; a row of them is carried into one title."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("i"), ((F.col("role") == "system") | (F.col("turn") % 5 == 4)).alias("heading"), "text")
    return M.chapters(rows, "conv_id")


_HEADING = M.HEADING.replace("(?![A-Za-z0-9_])", "\\b")  # of ASCII words, in the twin's dialect
_KIND = f"""CASE WHEN regexp_matches(j, '(?i)^\\[illustration') AND regexp_matches(j, '\\]$') THEN 'illustration'
WHEN n >= 3 AND len(list_filter(l, lambda x: regexp_matches(x, '{_HEADING}') OR regexp_matches(x, '^[IVXLC]+\\.?\\s') OR regexp_matches(x, '^[0-9]{{1,3}}\\.?\\s'))) / n >= 0.6 THEN 'toc'
WHEN n <= 3 AND length(j) <= 90 AND len(regexp_extract_all(j, '\\S+')) <= 12 AND (regexp_matches(l[1], '{_HEADING}') OR regexp_matches(l[1], '{M.ROMAN}') OR regexp_matches(l[1], '{M.NUMBER}')
  OR (length(regexp_replace(j, '[^A-Za-z]', '', 'g')) >= 3 AND regexp_replace(j, '[^A-Za-z]', '', 'g') = upper(regexp_replace(j, '[^A-Za-z]', '', 'g')) AND NOT regexp_matches(j, '[.!?]$'))) THEN 'heading'
WHEN n >= 2 AND len(list_filter(l, lambda x: length(x) < 55)) / n >= 0.75 AND list_sum(list_transform(l, lambda x: length(x))) / n < 46 THEN 'verse' ELSE 'para' END"""


@query(f"""WITH {sql.PARAS}, b AS (SELECT doc_id, c, CAST(p // 3 AS INTEGER) AS b, list(text ORDER BY p) AS l FROM paras GROUP BY ALL),
x AS (SELECT *, len(l) AS n, trim(regexp_replace(array_to_string(l, ' '), '\\s+', ' ', 'g')) AS j FROM b) SELECT doc_id, c, b, {_KIND} AS kind FROM x""")
def classify_block(spark, sf_dir):
    """Blocks of three lines."""
    rows = paragraphs(table(spark, sf_dir, "documents")).groupBy("doc_id", "c", F.floor(F.col("p") / 3).cast("int").alias("b"))
    lines = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "text"))), lambda t: t["text"]).alias("l"))
    return lines.select("doc_id", "c", "b", M.classify(F.col("l")).alias("kind"))


#: In the test documents, lines that begin so stand for licence markers.
_OPEN, _CLOSE = "^(The|Der|El|Le)([ .,]|$)", "^(With|Und|Con|Avec)([ .,]|$)"


@query(f"""WITH {sql.PARAS}, m AS (SELECT *, c * 20 + p AS pos, regexp_matches(text, '{_OPEN}') AS s, regexp_matches(text, '{_CLOSE}') AS e FROM paras),
st AS (SELECT *, min(pos) FILTER (e) OVER (PARTITION BY doc_id) AS stop FROM m), op AS (SELECT *, max(pos) FILTER (s AND (stop IS NULL OR pos < stop)) OVER (PARTITION BY doc_id) AS opn FROM st)
SELECT doc_id, c, p, text FROM op WHERE (opn IS NULL OR pos > opn) AND (stop IS NULL OR pos < stop)""")
def license_trim(spark, sf_dir):
    return M.between_markers(paragraphs(table(spark, sf_dir, "documents")).select("doc_id", "c", "p", "text"), _OPEN, _CLOSE)


_TITLES_IN = "SELECT page_id, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) || CASE page_id % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '_two.words-here.txt' WHEN 2 THEN '' ELSE '.fb2.zip' END AS name FROM pages"


@query(f"""WITH n AS ({_TITLES_IN}), t AS (SELECT *, regexp_replace(regexp_replace(name, '(?i)\\.(fb2|tar)\\.(zip|gz)$', ''), '(?i)\\.[a-z0-9]{{1,7}}$', '') AS b FROM n)
SELECT page_id, name, regexp_extract(lower(name), '\\.([a-z0-9]{{1,7}})$', 1) AS ext, coalesce(nullif(trim(regexp_replace(regexp_replace(b, '[_\\-.]+', ' ', 'g'), '\\s+', ' ', 'g')), ''), 'Untitled') AS title,
CASE WHEN length(trim(name)) < 2 OR regexp_matches(trim(name), '(?i)^untitled|^microsoft word|\\.(docx?|indd|qxd|pdf|tex|odt)$') THEN '' ELSE regexp_replace(trim(name), '\\s+', ' ', 'g') END AS meta_title FROM t""")
def clean_title(spark, sf_dir):
    """File names made from the last part of each url."""
    end = F.element_at(F.array(F.lit(".docx"), F.lit("_two.words-here.txt"), F.lit(""), F.lit(".fb2.zip")), (F.col("page_id") % 4 + 1).cast("int"))
    named = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1), end).alias("name"))
    return named.select("page_id", "name", X.file_ext(F.col("name")).alias("ext"), X.file_title(F.col("name")).alias("title"), X.clean_meta_title(F.col("name")).alias("meta_title"))
