"""A hierarchical index of 64-bit fingerprints in Gray order, and the join of all near pairs by it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Forest
from .work import stored

#: Children of a node: fingerprints of a leaf, nodes of an upper level.
FANOUT = 128
_NODE = "node long, pattern long, mask long, kids array<long>, patterns array<long>, masks array<long>"
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(bits: Column) -> Column:
    """The place of a 64-bit word in the reflected binary code, as a signed long of the same order."""
    for k in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, k))
    return bits.bitwiseXOR(F.lit(-(2**63)))


def shared_bits(patterns: np.ndarray, masks: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """The mask of bits that all children have and agree on, and their values."""
    differ = np.bitwise_or.reduce(patterns ^ patterns[0])
    mask = np.bitwise_and.reduce(masks) & ~differ
    return patterns[0] & mask, mask


def _nodes(fanout: int, leaf: bool):
    """Consecutive rows (kid, pattern, mask) of a sorted partition become nodes; at most `fanout` rows are held."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        held = np.empty((3, 0), np.uint64)

        def made(some: np.ndarray) -> dict:
            nonlocal n
            pattern, mask = shared_bits(some[1], some[2])
            n += 1
            signed = some.view(np.int64)
            return {"node": base | n - 1, "pattern": int(pattern.view(np.int64)), "mask": int(mask.view(np.int64)), "kids": signed[0], "patterns": signed[1] if not leaf else signed[1][:0], "masks": signed[2] if not leaf else signed[2][:0]}

        schema = pa.schema([(k, pa.int64()) for k in ("node", "pattern", "mask")] + [(k, pa.list_(pa.int64())) for k in ("kids", "patterns", "masks")])
        for batch in batches:
            new = np.vstack([batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(3)])
            held = np.hstack([held, new])
            rows = [made(held[:, at : at + fanout]) for at in range(0, held.shape[1] - fanout + 1, fanout)]
            held = held[:, len(rows) * fanout :]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if held.shape[1]:
            yield pa.RecordBatch.from_pylist([made(held)], schema=schema)

    return build


def build_index(prints: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the index, leaves first; the last level has one node. prints: distinct longs in column fp.

    Fingerprints are range-partitioned and sorted by Gray rank, so neighbours differ in few bits; runs of them become leaves, which
    keep the bits that all their members share as (pattern, mask); runs of nodes become nodes in the same way.
    """
    rank = gray_rank(F.col("fp"))
    rows = prints.select(F.col("fp").alias("kid"), F.col("fp").alias("pattern"), F.lit(-1).cast("long").alias("mask"), rank.alias("rank"))
    parted = rows.repartitionByRange("rank").sortWithinPartitions("rank").select("kid", "pattern", "mask")
    levels = [stored(parted.mapInArrow(_nodes(fanout, True), _NODE), "gray-0")]
    while (n := levels[-1].count()) > 1:
        rows = levels[-1].select(F.col("node").alias("kid"), "pattern", "mask")
        parts = -(-n // (8 * fanout)) if n > fanout else 1
        parted = rows.repartitionByRange(parts, "kid") if parts > 1 else rows.coalesce(1)
        levels.append(stored(parted.sortWithinPartitions("kid").mapInArrow(_nodes(fanout, False), _NODE), f"gray-{len(levels)}"))
    return levels


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [flat[a - ends[0] : b - ends[0]] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _expand(radius: int):
    """Pairs of nodes to the pairs of their children whose shared bits differ at most `radius` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy() for k in (0, 1))
            got = [[np.empty(0, np.uint64)], [np.empty(0, np.uint64)]]
            parts = [_lists(batch, x) for x in ("kids", "patterns", "masks", "kids2", "patterns2", "masks2")]
            for k, (ka, pa_, ma, kb, pb, mb) in enumerate(zip(*parts, strict=True)):
                near = np.bitwise_count((pa_[:, None] ^ pb) & (ma[:, None] & mb)) <= radius
                if a[k] == b[k]:
                    near = np.triu(near)
                i, j = np.nonzero(near)
                got[0].append(ka[i])
                got[1].append(kb[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in got], names=["a", "b"])

    return run


def _links(radius: int):
    """Pairs of leaves to links that span all near pairs between their fingerprints: at most one less than there are fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy() for k in (0, 1))
            sides = [batch.column(k).to_numpy().view(np.uint64) for k in (2, 3, 4, 5)]
            out: list[tuple[int, int]] = []
            for k, (x, y) in enumerate(zip(_lists(batch, "kids"), _lists(batch, "kids2"), strict=True)):
                (p, m), (p2, m2) = (sides[0][k], sides[1][k]), (sides[2][k], sides[3][k])
                if a[k] != b[k]:  # first each side's members against the other side's shared bits
                    x, y = x[np.bitwise_count((x ^ p2) & m2) <= radius], y[np.bitwise_count((y ^ p) & m) <= radius]
                if not len(x) or not len(y):
                    continue
                near = np.bitwise_count(x[:, None] ^ y) <= radius
                if a[k] == b[k]:
                    near = np.triu(near, 1)
                i, j = np.nonzero(near)
                if len(i) > len(x) + len(y):
                    forest = Forest()
                    for u, v in zip(x[i].tolist(), y[j].tolist(), strict=True):
                        forest.join(u, v)
                    out += forest.stars()
                else:
                    out += zip(x[i].tolist(), y[j].tolist(), strict=True)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def near_links(prints: DataFrame, radius: int, fanout: int = FANOUT) -> DataFrame:
    """(a, b): links that join all pairs of distinct fingerprints with at most `radius` differing bits, and no others' components.

    Both sides walk down the index together: a pair of nodes is followed only while the bits that each side shares within itself
    differ at most radius times, so whole groups are pruned. No pair within the radius is ever pruned. Where a pair of leaves holds
    more near pairs than fingerprints, a spanning forest of them stands for all; no limit is set on partners.
    """
    levels = build_index(prints, fanout)
    top = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    pairs = top
    for level in range(len(levels) - 1, -1, -1):
        one = levels[level]
        two = one.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}2") for c in ("pattern", "mask", "kids", "patterns", "masks")])
        # Pairs compress well, so their file size says little about what a broadcast would take.
        both = pairs.hint("merge").join(one.withColumnRenamed("node", "a"), "a").hint("merge").join(two, "b")
        if level:
            both = both.select("a", "b", *[f"{c}{s}" for s in ("", "2") for c in ("kids", "patterns", "masks")])
            pairs = stored(both.mapInArrow(_expand(radius), "a long, b long"), "pairs")
        else:
            both = both.select("a", "b", "pattern", "mask", "pattern2", "mask2", "kids", "kids2")
            return both.mapInArrow(_links(radius), "a long, b long")
    raise AssertionError
