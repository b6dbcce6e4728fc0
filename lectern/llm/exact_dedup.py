"""Exact duplicates by digest and full content, combined in three skew-safe steps. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import as_text, ascii_lower, stored

SALTS = 16


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """(digest, norm, keep_id, group_size): one row for each distinct normalised text.

    Local duplicates meet in the map-side aggregation, which sends at most one row for a text from each task. Those rows meet by
    digest, content and salt, so that a text found in every task still goes to `salts` places; then the salts' winners meet.
    All three groupings compare the whole content, so equal digests of different texts stay apart.
    """
    norm = docs.select(F.col(id_col).alias("id"), ascii_lower(as_text(F.col(text_col))).alias("norm"))
    keyed = norm.select("id", "norm", F.sha2("norm", 256).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = keyed.groupBy("digest", "norm", "salt").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z only. Null counts as the empty text, and all empty texts form
    one group. The largest id of a group stays; rows that repeat that very id all say kept (drop them by id where one row is
    wanted). Null ids lose to others; a group of null ids alone keeps the null. Other columns of docs, whatever their names, are
    not read. An empty table gives an empty result. Texts of any length are compared whole.
    """
    best = winners(docs, id_col, text_col, salts)
    best = stored(best.select("digest", "keep_id", "group_size", F.octet_length("norm").alias("bytes"), F.xxhash64("norm").alias("second")), "winners")
    norm = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(as_text(F.col(text_col))).alias("norm"))
    rows = norm.select("doc_id", F.sha2("norm", 256).alias("digest"))
    on = ["digest"]
    if not best.groupBy("digest").count().filter("count > 1").isEmpty():
        # Two texts with one SHA-256: their winners are told apart by length and a second hash, and failing that by nothing known.
        if not best.groupBy("digest", "bytes", "second").count().filter("count > 1").isEmpty():
            raise ValueError("different texts share SHA-256, length and XXH64")
        on = ["digest", "bytes", "second"]
        rows = norm.select("doc_id", F.sha2("norm", 256).alias("digest"), F.octet_length("norm").alias("bytes"), F.xxhash64("norm").alias("second"))
    return rows.join(best.select(*on, "keep_id", "group_size"), on).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )
