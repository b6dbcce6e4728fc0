"""From raw documents to packed sequences: five stages, each one of the operators of lectern.llm over all that the one before kept.

Documents are told apart by id and text together, so null and repeated ids lose nothing: `_key` is a digest of both. Stages pass all
columns on, whatever they are called: rows travel as one struct. Repeated rows are one document. Null texts count as empty. Empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.exact_dedup import exact_dedup
from lectern.llm.jaccard import jaccard_components
from lectern.llm.language_id import UNKNOWN, fit, identify
from lectern.llm.mixing import mix_documents
from lectern.llm.packing import best_fit_packing
from lectern.llm.work import as_text, ascii_lower, boxed, stored, unboxed

TOKENIZER = "byte_bpe_50k.json"


def _key() -> Column:
    return F.sha2(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))), 256)


def _inner(docs: DataFrame, *more: Column) -> DataFrame:
    """docs as a struct `row`, and beside it only columns that the stage names itself: whatever docs has else cannot meet them."""
    return docs.select(boxed(docs.columns), *more)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: those without letters and those that noise explains better than any language.

    The source plays the host.
    """
    model = fit(docs.select("doc_id", "text", "lang"))
    rows = _inner(docs, F.col("text").alias("t"), F.col("source").alias("s"))
    found = identify(rows, model, F.col("t"), host=F.col("s"), keep=["row"])
    return found.filter(F.col("language") != UNKNOWN).select(*unboxed(docs.columns))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays, once. Null ids lose to others."""
    kept = exact_dedup(docs.select("doc_id", "text")).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    kept = stored(kept, "exact-kept")
    tie = F.struct(*[F.col(c).cast("string") for c in ("text", "lang", "source")]).alias("tie")
    keyed = _inner(docs, F.col("doc_id").alias("id"), F.sha2(ascii_lower(as_text(F.col("text"))), 256).alias("sha"), tie)
    rows = keyed.join(kept, (F.col("sha") == F.col("kept_sha")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("sha", "id").orderBy("tie"))
    return rows.withColumn("nth", nth).filter("nth = 1").select(*unboxed(docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of a 5-word similarity of 0.8 or more join, the one with the smallest doc_id stays. Null ids lose to others.

    SimHash fingerprints and their index join the closest texts; the operator then completes the links, see jaccard.py.
    """
    who = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), _key().alias("key"))
    found = jaccard_components(docs.select(who.alias("doc_id"), "text"))
    kept = stored(found.filter("doc_id = component_id").select(F.col("doc_id.key").alias("key")).distinct(), "near-kept")
    return _inner(docs, _key().alias("key")).join(kept, "key", "left_semi").select(*unboxed(docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it: documents without words not at all, since they add nothing to any share."""
    copies = mix_documents(docs.select(_key().alias("doc_id"), "text", "source")).filter("copies > 0")
    copies = stored(copies.groupBy(F.col("doc_id").alias("key")).agg(F.max("copies").cast("int").alias("copies")), "copies")
    # Never a broadcast: the table of copies is as long as that of documents.
    rows = _inner(docs, _key().alias("key")).join(copies.hint("merge"), "key")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")).select(*unboxed(docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens; a document that comes twice is packed twice."""
    return best_fit_packing(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language_stage), ("exact", exact_stage), ("near", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Hashed shingles, rounding draws and token ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
