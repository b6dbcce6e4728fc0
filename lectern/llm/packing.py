"""Best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import encoder
from .work import TEXTS, as_text, stored

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids, closed with end_id, cut only where they exceed capacity.

    The first piece takes what is over, so that all later pieces are exactly capacity long. Null and empty texts are one piece
    with the end id alone. Repeated rows give repeated pieces. A null id stays null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            docs, at_doc = batch.column(0), 0
            for ids, counts in enc.encode(batch.column(1)):
                data, doc_ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                parts = -(-(counts + 1) // capacity)
                of = np.repeat(np.arange(len(counts)), parts)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
                to = counts[of] + 1 - capacity * (parts[of] - 1 - piece)
                start = np.where(piece, to - capacity, 0)
                base = (doc_ends - counts)[of]
                last = piece == parts[of] - 1
                crcs = [zlib.crc32(end, zlib.crc32(data[4 * a : 4 * b - 4])) if z else zlib.crc32(data[4 * a : 4 * b]) for a, b, z in zip((base + start).tolist(), (base + to).tolist(), last.tolist(), strict=True)]
                columns = [docs.take(pa.array(at_doc + of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(to - start), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])
                at_doc += len(counts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text(F.col("text")).alias("text")).mapInArrow(cut, PIECES)


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts. Rows: length, first rank, end rank, first sequence, items a sequence, offset of the first.

    Equal sequences are kept as runs (first, number), so the work depends on the number of lengths and not of documents. Items of
    one length go to the fullest sequences with room, as many to each as fit; new sequences are opened when none has room.
    """
    runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free room
    plan: list[tuple[int, int, int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank, room = counts[length], 0, length
        while left:
            while room <= capacity and not runs[room]:
                room += 1
            if room > capacity:
                room = capacity
                number = -(-left // (capacity // length))
                runs[room].append((opened, number))
                opened += number
            at, number = runs[room].pop()
            each = room // length
            full = min(number, left // each)
            if full:
                plan.append((length, rank, rank + full * each, at, each, capacity - room))
                runs[room - each * length].append((at, full))
                rank, left, at, number = rank + full * each, left - full * each, at + full, number - full
            if number and left and left < each:
                plan.append((length, rank, rank + left, at, left, capacity - room))
                runs[room - left * length].append((at, 1))
                rank, left, at, number = rank + left, 0, at + 1, number - 1
            if number:
                runs[room].append((at, number))
    return np.array(sorted(plan), dtype=np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, keys: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32"), capacity: int = CAPACITY) -> DataFrame:
    """pieces plus sequence_id and offset: each piece's place in sequences of at most capacity, gapless from 0.

    The plan is made from at most `capacity` counts. Then each piece takes the planned slot of its rank among pieces of its length.
    Ranks come from runs of about the square root of the number of pieces, chosen by a hash, and the sums of the runs before: no
    length, however common, is sorted in one task, and keys hold the pieces' checksums, so that neither null ids nor one that many
    documents share make a run larger; only equal pieces share one. Equal pieces may swap ranks; the set of rows is the same on each run.
    Lengths must lie in 1..capacity. An empty table gives an empty result.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= x <= capacity for x in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    plan = best_fit_plan(counts, capacity)
    run = max(256, math.isqrt(sum(counts.values())))
    sizes = F.create_map(*[F.lit(x) for pair in counts.items() for x in (int(pair[0]), -(-pair[1] // run))]) if counts else F.create_map()
    spread = F.coalesce(sizes[F.col("length")], F.lit(1)) if counts else F.lit(1)
    dealt = pieces.withColumn("_run", F.pmod(F.xxhash64(*keys), spread))
    here = Window.partitionBy("length", "_run").orderBy(*keys)
    before = Window.partitionBy("length").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "_run").count().select("length", "_run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(here)).join(starts, ["length", "_run"])
    ranked = ranked.select(*pieces.columns, (F.col("_rank") - 1 + F.col("_before")).cast("long").alias("_rank"))
    low = plan[:, 0] << 44 | plan[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch.pop("_rank").to_numpy()
            length = batch["length"].to_numpy()
            slot = plan[np.searchsorted(low, length.astype(np.int64) << 44 | rank, side="right") - 1]
            nth = rank - slot[:, 1]
            batch["sequence_id"] = slot[:, 3] + nth // slot[:, 4]
            batch["offset"] = slot[:, 5] + nth % slot[:, 4] * length
            yield batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInPandas(place, schema)


def best_fit_packing(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises, cuts and packs documents. One row per piece; see token_pieces and pack for nulls, repeats and empty tables."""
    return pack(stored(token_pieces(docs, tokenizer, end_id, capacity), "pieces", TEXTS), capacity=capacity)
