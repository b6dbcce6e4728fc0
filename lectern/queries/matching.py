"""The shingle index and passages located by it: benchmark items in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import js_round
from ..operators import matching as M
from ..plans.corpus import paragraphs
from ..registry import query, table
from . import sql

_INDEX = f"""WITH {sql.PARAS},
tok AS (SELECT doc_id, c, p, text, list_filter(string_split({sql.norm('text')}, ' '), lambda w: w <> '') AS t FROM paras),
sh AS (SELECT doc_id, c, p, unnest(range(len(t) - 3)) AS i, t FROM tok WHERE len(t) >= 4),
keyed AS (SELECT doc_id, c, p, i, array_to_string(t[i + 1:i + 4], ' ') AS key FROM sh),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY c, p, i) AS rn FROM keyed),
post AS (SELECT doc_id, key, c, p, i, count(*) OVER (PARTITION BY doc_id, key) AS n FROM ranked WHERE rn <= 64)"""

_HITS = f"""{_INDEX},
qt AS (SELECT item_id, list_filter(string_split({sql.norm('text')}, ' '), lambda w: w <> '') AS t FROM benchmark),
qs AS (SELECT item_id, unnest(range(len(t) - 3)) AS qi, t FROM qt WHERE len(t) >= 6),
qk AS (SELECT item_id, qi, len(t) AS n_tokens, array_to_string(t[qi + 1:qi + 4], ' ') AS key FROM qs),
hits AS (SELECT item_id, n_tokens, doc_id, qi, c, p, i AS nw, n FROM qk JOIN post USING (key)),
votes AS (SELECT item_id, doc_id, c, p, round(sum(1 / sqrt(n)), 9) AS votes, min({{'qi': qi, 'c': c, 'p': p, 'nw': nw}}) AS seen FROM hits GROUP BY ALL)"""

_MATCH = f"""{_HITS},
best AS (SELECT item_id, doc_id, c, p AS bp FROM votes QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY votes DESC, seen) = 1),
lens AS (SELECT doc_id, c, p, len(t) AS len, coalesce(sum(len(t)) OVER (PARTITION BY doc_id, c ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM tok),
near AS (SELECT h.*, l.len, l.off + h.nw - h.qi AS diag FROM hits h JOIN best b USING (item_id, doc_id, c) JOIN lens l USING (doc_id, c, p) WHERE abs(h.p - b.bp) <= 8),
med AS (SELECT item_id, doc_id, list_sort(list(diag))[count(*) // 2 + 1] AS med FROM near GROUP BY ALL),
good AS (SELECT n.* FROM near n JOIN med m USING (item_id, doc_id) WHERE abs(n.diag - m.med) <= 15),
o AS (SELECT item_id, doc_id, c, any_value(n_tokens) AS n_tokens, count(DISTINCT qi) AS matched, min({{'qi': qi, 'p': p, 'nw': nw, 'len': len}}) AS a, max({{'qi': qi, 'p': p, 'nw': nw, 'len': len}}) AS b FROM good GROUP BY ALL),
m AS (SELECT item_id, doc_id, c, matched, n_tokens - 3 AS total, least(1.0, matched / (n_tokens - 3)) AS confidence, a.p AS start_p, greatest(0, a.nw - least(2, a.qi)) AS start_nw,
      b.p AS end_p, least(greatest(0, b.len - 1), b.nw + 3 + least(2, greatest(0, n_tokens - (b.qi + 4)))) AS end_nw FROM o)"""


def _paras(spark, sf_dir):
    return paragraphs(table(spark, sf_dir, "documents"))


@query(f"{_INDEX} SELECT doc_id, key AS shingle, count(*) AS postings, min(c * 1000 + p) AS first_para FROM post GROUP BY ALL")
def shingle_index(spark, sf_dir):
    return M.postings(_paras(spark, sf_dir)).groupBy("doc_id", F.col("key").alias("shingle")).agg(F.count("*").alias("postings"), F.min(F.col("c") * 1000 + F.col("p")).alias("first_para"))


@query(f"{_HITS} SELECT item_id, doc_id, c, p, votes FROM votes")
def shingle_votes(spark, sf_dir):
    found, _ = M.hits(_paras(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return M.votes(found).drop("seen")


@query(f"{_MATCH} SELECT item_id, doc_id, c, matched, total, {sql.js_round('confidence', 4)} AS confidence, start_p, start_nw, end_p, end_nw FROM m")
def match_passage(spark, sf_dir):
    found = M.match(_paras(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.withColumn("confidence", js_round(F.col("confidence"), 4))


@query(f"""{_MATCH}, {sql.SENTENCES},
fw AS (SELECT doc_id, c, p, s, word_start, unnest(regexp_extract_all(text, '\\S+')) AS word, generate_subscripts(regexp_extract_all(text, '\\S+'), 1) - 1 AS w FROM sentences SEMI JOIN m ON sentences.doc_id = m.doc_id),
fk AS (SELECT *, len(list_filter(string_split({sql.norm('word')}, ' '), lambda z: z <> '')) AS k FROM fw),
fr AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY doc_id, c, p ORDER BY s, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM fk),
pw AS (SELECT doc_id, c, p, regexp_extract_all(text, '\\S+') AS al FROM paras)
SELECT m.item_id, m.doc_id, m.c, m.start_p AS p, fr.s, fr.w, array_to_string(al[word_start + fr.w + 1:word_start + fr.w + 14], ' ') || CASE WHEN len(al) - word_start - fr.w >= 14 THEN '…' ELSE '' END AS snippet
FROM m JOIN fr ON fr.doc_id = m.doc_id AND fr.c = m.c AND fr.p = m.start_p AND m.start_nw >= f AND m.start_nw < f + k JOIN pw ON pw.doc_id = m.doc_id AND pw.c = m.c AND pw.p = m.start_p""")
def match_location(spark, sf_dir):
    paras = _paras(spark, sf_dir)
    points = M.match(paras, table(spark, sf_dir, "benchmark")).select("item_id", "doc_id", "c", F.col("start_p").alias("p"), F.col("start_nw").alias("nw"))
    return M.to_locator(points, paras).select("item_id", "doc_id", "c", "p", "s", "w", "snippet")


@query(f"{_MATCH} SELECT item_id, doc_id, {sql.js_round('confidence * 100')} AS percent, CASE WHEN confidence * 100 >= 55 THEN 'strong' WHEN confidence * 100 >= 30 THEN 'likely' ELSE 'weak' END AS quality FROM m")
def match_confidence(spark, sf_dir):
    percent = F.col("confidence") * 100
    found = M.match(_paras(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "doc_id", js_round(percent).alias("percent"), F.when(percent >= 55, "strong").when(percent >= 30, "likely").otherwise("weak").alias("quality"))


@query(f"""WITH {sql.PARAS}, edge AS (SELECT *, count(*) OVER (PARTITION BY doc_id, c) AS n FROM paras),
e AS (SELECT doc_id, c, p, regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '[^\\p{{L}}#]', '', 'g') AS key FROM edge WHERE p < 2 OR p >= n - 2),
pages AS (SELECT doc_id, count(DISTINCT c) AS pages FROM paras GROUP BY doc_id)
SELECT e.doc_id, e.key, count(DISTINCT e.c) AS on_pages FROM e JOIN pages USING (doc_id) WHERE length(key) >= 2 AND pages >= 3 GROUP BY e.doc_id, e.key, pages HAVING count(DISTINCT e.c) >= greatest(3, ceil(0.3 * pages))""")
def repeated_lines(spark, sf_dir):
    """Lines at the edges of pages (here chapters) that come back on many of them."""
    from ..operators.layout import furniture

    return furniture(_paras(spark, sf_dir).select("doc_id", F.col("c").alias("page"), F.col("p").alias("line"), "text"))
