"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_files import read_arrow, write_arrow
from .codebooks import product_codes
from .curves import nearest
from .embedding_dedup import embedding_components
from .exact_dedup import exact_dedup
from .hmm import score_documents
from .language_id import fit, identify_pages
from .mixing import mix_documents
from .packing import best_fit_packing
from .phrase_sql import phrase_sql
from .phrases import collocations
from .simhash import simhash_components
from .url_filter import filter_pages, made_pages
from .url_sql import MADE_PAGES, url_sql
from .vector_sql import codes_sql, neighbours_sql
from .warc import read_warc, write_warc
from .work import dealt, fresh_path

#: The tokenizer of the packing and Arrow queries.
TOKENIZER = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(dealt(_read(spark, sf_dir, "documents")), public_tokenizers.path(TOKENIZER))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(_read(spark, sf_dir, "embeddings"), threshold=0.98)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_pages(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "verdict_by")


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 over pages that declare links: each page of the table with a url and a link made by rule."""
    return filter_pages(made_pages(_read(spark, sf_dir, "pages"))).select("page_id", "host", "path", "rule", "verdict", "verdict_by")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(_read(spark, sf_dir, "pages"), fresh_path(spark, "warc"), min_bytes=0)
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(dealt(_read(spark, sf_dir, "documents")), words=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op8_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(dealt(_read(spark, sf_dir, "documents")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(_read(spark, sf_dir, "documents"))
    return identify_pages(dealt(_read(spark, sf_dir, "pages")), model)


def op10_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return read_arrow(write_arrow(docs, fresh_path(spark, "arrow"), public_tokenizers.path(TOKENIZER)))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes(_read(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(dealt(_read(spark, sf_dir, "documents")), least=30, top=2000, within=80)


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_mixing": op4_mixing,
    "op5_warc": op5_warc,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_hmm_scoring": op8_hmm_scoring,
    "op9_language_id": op9_language_id,
    "op10_arrow_token_files": op10_arrow_token_files,
    "op11_vector_codes": op11_vector_codes,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_nearest_neighbours": op13_nearest_neighbours,
    "url_aliases": url_aliases,
}

ORACLE_SQL = {
    "op3_url_filter": url_sql("SELECT page_id, url, html FROM pages"),
    "url_aliases": url_sql(MADE_PAGES),
    "op11_vector_codes": codes_sql(),
    "op12_phrase_collocations": phrase_sql(),
    "op13_nearest_neighbours": neighbours_sql(),
    "op2_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
     links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
               WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
     reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
     comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a), n AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.k, 0) AS n_links, comp.c AS component_id, e.vec_id = comp.c AS kept
FROM embeddings e JOIN comp ON comp.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op5_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     g AS (SELECT body, min(page_id) AS first FROM p GROUP BY body),
     h AS (SELECT p.page_id, octet_length(p.body) AS payload_bytes, sha1(p.body) AS hex, g.first FROM p JOIN g USING (body))
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM h""",
    "op7_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)""",
}
