"""Text core: sentences, words, normal form, syllables, readability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import count_words, fnv1a, normalize, syllables, words
from ..operators.readability import READABILITY, readability
from ..plans.corpus import paragraphs, sentences
from ..plans.shared import kept
from ..registry import query, table
from . import sql


@query(f"WITH {sql.PARAS}, {sql.SENTENCES} SELECT doc_id, c, p, s, start, text AS sentence FROM sentences")
def sentence_split(spark, sf_dir):
    return sentences(paragraphs(table(spark, sf_dir, "documents"))).select("doc_id", "c", "p", "s", "start", F.col("text").alias("sentence"))


@query(f"WITH {sql.PARAS} SELECT doc_id, CAST(sum(pwc) AS BIGINT) AS words, count(DISTINCT c) AS chapters, count(*) AS paragraphs FROM paras GROUP BY doc_id")
def word_count(spark, sf_dir):
    paras = paragraphs(table(spark, sf_dir, "documents"))
    return paras.groupBy("doc_id").agg(F.sum("pwc").alias("words"), (F.max("c") + 1).cast("long").alias("chapters"), F.count("*").alias("paragraphs"))


@query(f"WITH {sql.PARAS}, {sql.SENTENCES} SELECT doc_id, c, p, s, n_words, word_start FROM sentences")
def word_offsets(spark, sf_dir):
    return sentences(paragraphs(table(spark, sf_dir, "documents"))).select("doc_id", "c", "p", "s", "n_words", "word_start")


@query(f"SELECT doc_id, {sql.norm('text')} AS norm FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", normalize(F.col("text")).alias("norm"))


@query(f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\S+')) AS word FROM documents) SELECT word, {sql.syllables('word')} AS syllables FROM w")
def syllable_counts(spark, sf_dir):
    distinct = table(spark, sf_dir, "documents").select(F.explode(words(F.col("text"))).alias("word")).distinct()
    return distinct.select("word", syllables(F.col("word")).alias("syllables"))


@query("""
WITH RECURSIVE u AS (SELECT p_partkey, list_transform(string_split(p_name, ''), lambda ch: unicode(ch)) AS l FROM part),
     f AS (SELECT p_partkey, l, 1 AS i, 2166136261::BIGINT AS h FROM u UNION ALL SELECT p_partkey, l, i + 1, (xor(h, l[i]) * 16777619) & 4294967295 FROM f WHERE i <= len(l))
SELECT p_partkey, h AS fnv, h % 10 AS colour FROM f WHERE i = len(l) + 1""")
def fnv_hash(spark, sf_dir):
    """The palette colour of a title: the hash of a part's whole name."""
    hashed = table(spark, sf_dir, "part").select("p_partkey", fnv1a(F.col("p_name")).alias("fnv"))
    return hashed.select("p_partkey", "fnv", (F.col("fnv") % 10).alias("colour"))


_SAMPLED = f"""WITH {sql.PARAS},
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c, p) - 1 AS k, greatest(1, count(*) OVER (PARTITION BY doc_id) // 150) AS step FROM paras),
strided AS (SELECT *, coalesce(sum(pwc) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM n WHERE k % step = 0),
keep AS (SELECT doc_id, c, p, text, pwc FROM strided WHERE seen < 5000),
"""
_COUNTS = """, w AS (SELECT doc_id, c, p, s, unnest(regexp_extract_all(text, '\\S+')) AS word FROM sentences),
ws AS (SELECT doc_id, count(*) AS words, sum(sy) AS syll, count(*) FILTER (sy >= 3) AS long_words FROM (SELECT doc_id, """ + sql.syllables("word") + """ AS sy FROM w) GROUP BY doc_id),
ss AS (SELECT doc_id, count(*) AS sentences, count(*) FILTER (regexp_matches(text, '["“”]')) AS dialogue FROM sentences GROUP BY doc_id),
r AS (SELECT doc_id, words, sentences, words / sentences AS wps, syll / words AS spw, dialogue / sentences AS dl, long_words / words AS lw FROM ws JOIN ss USING (doc_id)),
f AS (SELECT *, 206.835 - 1.015 * wps - 84.6 * spw AS fl, 0.39 * wps + 11.8 * spw - 15.59 AS gr FROM r),
readability AS (SELECT doc_id, words, sentences, """ + f"""{sql.js_round('fl')} AS flesch, {sql.js_round('greatest(0, gr)', 1)} AS grade, {sql.js_round('wps', 1)} AS words_per_sentence, {sql.js_round('spw', 2)} AS syllables_per_word,
  {sql.js_round('dl', 3)} AS dialogue_share, {sql.js_round('lw', 3)} AS long_word_share, CASE WHEN fl >= 70 THEN 'Light' WHEN fl >= 50 THEN 'Moderate' ELSE 'Dense' END AS band FROM f)"""
_READ = _SAMPLED + sql.SENTENCES.replace("FROM paras)),", "FROM keep)),", 1) + _COUNTS


@query(_READ + " SELECT * FROM readability")
def readability_doc(spark, sf_dir):
    return readability(paragraphs(table(spark, sf_dir, "documents"))).select("doc_id", *READABILITY)


@query(_READ + f""" SELECT lang, count(*) AS docs, {sql.js_round('avg(flesch)', 3)} AS avg_flesch, {sql.js_round('avg(grade)', 3)} AS avg_grade, count(*) FILTER (band = 'Dense') AS dense
FROM readability JOIN documents USING (doc_id) GROUP BY lang""")
def readability_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _by_lang(docs, readability(paragraphs(docs)))


def _by_lang(docs, scores):
    from ..functions.text import js_round

    rows = docs.select("doc_id", "lang").join(scores, "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), js_round(F.avg("flesch"), 3).alias("avg_flesch"), js_round(F.avg("grade"), 3).alias("avg_grade"), F.count_if(F.col("band") == "Dense").alias("dense"))


@query(_READ + f""" SELECT quality, toxic, count(*) AS docs, {sql.js_round('avg(flesch)', 3)} AS avg_flesch, CAST(sum(words) AS BIGINT) AS words FROM readability JOIN labels USING (doc_id) GROUP BY ALL""")
def readability_by_label(spark, sf_dir):
    from ..functions.text import js_round

    rows = readability(paragraphs(table(spark, sf_dir, "documents"))).join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("quality", "toxic").agg(F.count("*").alias("docs"), js_round(F.avg("flesch"), 3).alias("avg_flesch"), F.sum("words").alias("words"))


@query(f"WITH n AS (SELECT doc_id, {sql.norm('text')} AS t FROM documents) SELECT a.doc_id, b.first_id, b.copies FROM n a JOIN (SELECT t, min(doc_id) AS first_id, count(*) AS copies FROM n GROUP BY t HAVING count(*) > 1) b USING (t)")
def duplicate_docs(spark, sf_dir):
    """Documents whose normal forms are equal. Digests are worked out once and kept; no text is shuffled for them."""
    keyed = kept(table(spark, sf_dir, "documents").select("doc_id", F.sha2(normalize(F.col("text")), 256).alias("key")), "digests")
    groups = keyed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    return keyed.join(groups, "key").select("doc_id", "first_id", "copies")


@query("SELECT role, count(*) AS turns, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS words, count(*) FILTER (regexp_matches(text, '[\"“”]')) AS quoted FROM conversations GROUP BY role")
def dialogue_by_role(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("role").agg(F.count("*").alias("turns"), F.sum(count_words(F.col("text"))).cast("long").alias("words"), F.count_if(F.col("text").rlike("[\"“”]")).alias("quoted"))
