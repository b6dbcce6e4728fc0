"""SimHash fingerprints of word shingles, and near duplicates by them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gray_index import near_links
from .graph import connected_components
from .work import TEXTS, as_text, stored

#: Words whose shingles are hashed at a time.
_STEP = 100_000
_BITS = np.arange(64, dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint: bits that over half of n hashes have."""
    return int((np.uint64(1) << _BITS)[2 * counts > n].sum(dtype=np.uint64))


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half the XXH64 of all shingles, repeats included; no words: zero."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six ASCII blanks only
    if not tokens:
        return 0
    counts, n = np.zeros(64, np.int64), max(1, len(tokens) - words + 1)
    for at in range(0, n, _STEP):
        some = tokens[at : min(at + _STEP, n) + words - 1]
        line = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
        begin = np.concatenate([[0], ends[:-1] + 1])
        width = min(words, len(some))
        cuts = map(line.__getitem__, map(slice, begin[: len(some) - width + 1].tolist(), ends[width - 1 :].tolist()))
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in cuts), np.uint64)
        counts += bit_counts(hashes)
    return majority(counts, n)


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null texts are empty; texts are read whole, in steps of bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), as_text(F.col(text_col)).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per input row; component_id is the smallest doc_id reachable over links.

    Documents link when their fingerprints differ in at most `radius` bits; documents with one fingerprint are one class and are
    compared once. Texts without words share fingerprint zero. Repeated rows come out repeated; null ids count only where a
    component has no other. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, words, seed, id_col, text_col), "prints", TEXTS)
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    if classes.isEmpty():
        return prints.select("doc_id", "fp", F.col("doc_id").alias("component_id"))
    joined = connected_components(near_links(classes.select("fp"), radius))
    named = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
