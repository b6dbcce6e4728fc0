"""Voices over the test tables: suppliers speak, customers are personas, documents ask."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import voices as V
from ..registry import query, table

_SEGMENTS = ["automobile", "building", "furniture", "household", "machinery"]


def _voices(spark, sf_dir):
    segment = F.get(F.array(*[F.lit(s) for s in _SEGMENTS]), (F.col("s_suppkey") % 5).cast("int"))
    labels = F.array(segment, F.concat(F.lit("N"), "s_nationkey"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("voice"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), labels.alias("labels"), F.when(F.col("s_suppkey") % 3 == 0, "premade").otherwise("cloned").alias("category"))


def _personas(spark, sf_dir):
    k = F.col("c_custkey")
    hints = F.when(k % 4 == 0, F.array(F.lit("Nobody"), F.concat(F.lit("SUPPLIER#00000000"), k % 9))).otherwise(F.array().cast("array<string>"))
    labels = F.when(k % 11 == 1, F.array(F.lit("nowhere"))).otherwise(F.array(F.lower("c_mktsegment"), F.concat(F.lit("n"), "c_nationkey")))
    return table(spark, sf_dir, "customer").select(k.alias("persona"), F.when(k % 7 == 0, k).alias("override"), hints.alias("hints"), labels.alias("labels"))


_BASE = f"""WITH v AS (SELECT s_suppkey AS voice, lower(s_name) AS name, {_SEGMENTS!r}[1 + s_suppkey % 5] || ' n' || s_nationkey || ' ' || lower(s_name) AS text, CASE WHEN s_suppkey % 3 = 0 THEN 0.2 ELSE 0 END AS extra FROM supplier),
p AS (SELECT c_custkey AS persona, CASE WHEN c_custkey % 7 = 0 THEN c_custkey END AS override, CASE WHEN c_custkey % 4 = 0 THEN 'supplier#00000000' || c_custkey % 9 END AS hint, CASE WHEN c_custkey % 11 = 1 THEN ['nowhere'] ELSE [lower(c_mktsegment), 'n' || c_nationkey] END AS labels FROM customer),
kinds AS (SELECT DISTINCT labels FROM p), s AS (SELECT labels, voice, extra + len(list_filter(labels, lambda l: contains(text, l))) AS score FROM kinds, v),
l AS (SELECT labels, arg_min(voice, (-score, voice)) AS labelled FROM s GROUP BY labels), hs AS (SELECT DISTINCT hint FROM p WHERE hint IS NOT NULL), h AS (SELECT hint, min(voice) AS hinted FROM hs JOIN v ON starts_with(name, hint) GROUP BY hint)"""


@query(f"""{_BASE} SELECT persona, coalesce(override, hinted, labelled) AS voice, CASE WHEN override IS NOT NULL THEN 'choice' WHEN hinted IS NOT NULL THEN 'hint' ELSE 'labels' END AS why FROM p LEFT JOIN h USING (hint) LEFT JOIN l USING (labels)""")
def persona_voice(spark, sf_dir):
    """A voice for each persona: own choice, hints in order, labels."""
    return V.resolve(_personas(spark, sf_dir), _voices(spark, sf_dir))


@query("""WITH d AS (SELECT CASE n_regionkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'it' END AS language, n_nationkey AS ord, n_name AS voice FROM nation), f AS (SELECT language, arg_min(voice, ord) AS usual FROM d GROUP BY language),
w AS (SELECT doc_id AS id, lang AS language, CASE WHEN lang = 'en' AND doc_id % 5 = 0 THEN 'choice ' || doc_id % 3 END AS a, CASE WHEN lang = 'en' AND doc_id % 5 < 3 THEN 'own ' || doc_id % 4 END AS b, CASE WHEN lang = 'es' THEN 'es voice' END AS c FROM documents)
SELECT id, coalesce(a, b, c, usual, (SELECT usual FROM f WHERE language = 'en')) AS voice, CASE WHEN a IS NOT NULL THEN 'persona choice' WHEN b IS NOT NULL THEN 'persona' WHEN c IS NOT NULL THEN 'language choice' WHEN usual IS NOT NULL THEN 'language' ELSE 'home' END AS why FROM w LEFT JOIN f USING (language)""")
def language_voice(spark, sf_dir):
    """A voice for each document: persona, then language, then default, each reached by some."""
    k = F.col("doc_id")
    wanted = table(spark, sf_dir, "documents").select(k.alias("id"), (k % 5).alias("persona"), F.col("lang").alias("language"), F.when(k % 5 == 0, F.concat(F.lit("choice "), k % 3)).alias("persona_choice"), F.when(k % 5 < 3, F.concat(F.lit("own "), k % 4)).alias("persona_voice"))
    chosen = wanted.filter("language = 'es'").select("language", F.lit("es voice").alias("voice")).distinct()
    region = F.col("n_regionkey") % 3
    defaults = table(spark, sf_dir, "nation").select(F.when(region == 0, "en").when(region == 1, "fr").otherwise("it").alias("language"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("voice"))
    return V.for_language(wanted, chosen, defaults)


@query(f"""WITH v AS (SELECT s_suppkey, s_nationkey, s_name AS name, {[*V.FAMILIES[::-1], "?"]!r}[1 + s_suppkey % 5] AS family FROM supplier)
SELECT s_suppkey, family, row_number() OVER (PARTITION BY s_nationkey ORDER BY coalesce(list_position({list(V.FAMILIES)!r}, family), 0), name) AS place FROM v""")
def voice_families(spark, sf_dir):
    """Voices of each language (nation) in the order of families."""
    family = F.get(F.array(*[F.lit(f) for f in [*V.FAMILIES[::-1], "?"]]), (F.col("s_suppkey") % 5).cast("int"))
    return V.in_families(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.col("s_name").alias("name"), family.alias("family")), ["s_nationkey"]).select("s_suppkey", "family", "place")
