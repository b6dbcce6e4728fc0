"""Near duplicates of embeddings by randomised-rotation binary codes with correction factors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .work import stored

#: Vectors that a cell of the code should hold: comparing some thousands costs less than sending a vector to many smaller cells.
CELL = 4096
#: Rows of either side that one comparison block holds, and probes that are compared at a time.
HOMES, PROBES, STEP = 4096, 4096, 512
#: Slack for rounding in the bounds; pairs within it are decided by the exact cosine.
SLACK = 1e-7
#: Dimensions up to which the rotation is a full random matrix.
DENSE = 512
#: Bits of a code that may name a cell, and slack for their coordinates, which are kept in single precision.
CELL_BITS, CELL_SLACK = 30, 1e-6
#: Vectors in a batch between the JVM and Python.
BATCH = 2000


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in each task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(unit: np.ndarray, seed: int) -> np.ndarray:
    """Unit vectors under a random rotation. Long ones are filled up with zeros to a power of two and turned by three rounds of random
    signs and Walsh-Hadamard steps, whose cost grows with n log n and which need no matrix."""
    dim = unit.shape[1]
    if dim <= DENSE:
        return unit @ rotation(dim, seed)
    size = 1 << (dim - 1).bit_length()
    out = np.pad(unit, ((0, 0), (0, size - dim)))
    rng = np.random.default_rng([seed, dim])
    for _ in range(3):
        out = out * rng.choice([-1.0, 1.0], size)
        half = 1
        while half < size:
            x = out.reshape(len(out), -1, 2, half)
            out = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(out), size)
            half *= 2
        out /= np.sqrt(size)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def encode(unit: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """What is stored of unit vectors. code: the corner of the rotated cube nearest to each, a bit a dimension; factor: their inner product,
    which corrects estimates; query: the rotated vector in steps of `scale`, 8 bits a dimension, and `off`, how far that is from it."""
    turned = rotated(unit, seed)
    scale = np.abs(turned).max(axis=1) / 127
    query = np.rint(turned / scale[:, None]).astype(np.int8)
    return {
        "code": np.packbits(turned > 0, axis=1), "factor": np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1]), "query": query, "scale": scale,
        "off": np.sqrt(((turned - query * scale[:, None]) ** 2).sum(axis=1)), "turned": turned,
    }


def corners(code: np.ndarray, dim: int) -> np.ndarray:
    """Codes as the signs of their corners."""
    return np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1


def estimates(query: np.ndarray, scale: np.ndarray, signs: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Unbiased estimates of all inner products between queries and coded vectors: the product of a query with the corner, over the
    corner's factor, has the true product as its mean over rotations. Sums of signed 8-bit steps are exact in single precision."""
    sums = query.astype(np.float32) @ signs.T
    return sums * (scale[:, None] / np.sqrt(query.shape[1])) / factor


def surely_below(estimate: np.ndarray, factor: np.ndarray, off: np.ndarray, threshold: float) -> np.ndarray:
    """True where the confidence bound excludes a product of `threshold` or more.

    The component of a query that is orthogonal to a coded vector has length sqrt(1 - c^2) at cosine c and meets a corner residual of
    length sqrt(1 - factor^2), and rounding moves the query by `off`: the estimate is off by at most their sum over the factor. The
    bound holds with certainty.
    """
    width = (np.sqrt(max(0.0, 1 - threshold**2)) * np.sqrt(np.maximum(0, 1 - factor**2)) + off[:, None]) / factor
    return estimate < threshold - width - SLACK


_CODED = "label {label}, dim int, vid long, k1 long, k2 long, copies long, embedding {embedding}, first long, code binary, factor double, query binary, scale double, off double, head array<float>"


def _codes(seed: int):
    """A row per class: its code, factor and 8-bit query, and the first rotated coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                chosen = np.flatnonzero(dims == dim)
                for part in np.array_split(chosen, -(-len(chosen) // max(1, min(2000, 2_000_000 // max(1, dim))))):
                    some = batch.take(pa.array(part))
                    made = encode(_unit(_matrix(some.column(6))), seed)
                    head = made["turned"][:, :CELL_BITS].astype(np.float32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * head.shape[1]), pa.array(head.ravel()))
                    packed = [pa.array([x.tobytes() for x in made[k]], pa.binary()) for k in ("code", "query")]
                    columns = [*some.columns, packed[0], pa.array(made["factor"]), packed[1], pa.array(made["scale"]), pa.array(made["off"]), lists]
                    yield pa.RecordBatch.from_arrays(columns, names=[*some.schema.names, "code", "factor", "query", "scale", "off", "head"])

    return run


def _cells(threshold: float):
    """A row per class and cell: its home (the code's first bits) and all cells in which a vector within the threshold may live.

    If bits S of two codes differ, the vectors' distance is at least the length of either's coordinates in S. So a vector with
    cosine >= threshold has its home in a cell that flips bits whose squared coordinates add up to at most 2 - 2 threshold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = {name: k for k, name in enumerate(batch.schema.names)}
            bits, heads = batch.column(place["bits"]).to_numpy(), batch.column(place["head"])
            ends = heads.offsets.to_numpy()
            flat = np.append(heads.flatten().to_numpy().astype(np.float64), 0.0)
            begin = ends[:-1] - ends[0]
            row, used, home = np.arange(batch.num_rows), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i in range(int(bits.max(initial=0))):
                home |= np.where(i < bits, (flat[np.minimum(begin + i, len(flat) - 1)] > 0).astype(np.int64) << i, 0)
            cell = home.copy()
            for i in range(int(bits.max(initial=0))):
                more = used + flat[np.minimum(begin[row] + i, len(flat) - 1)] ** 2
                go = (i < bits[row]) & (more <= (2 - 2 * threshold) + CELL_SLACK)
                row, cell, used = np.append(row, row[go]), np.append(cell, cell[go] ^ (1 << i)), np.append(used, more[go])
            out = batch.select(["label", "dim", "vid", "copies", "code", "factor", "query", "scale", "off"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell), pa.array(cell == home[row])], names=[*out.schema.names, "cell", "home"])

    return run


_KEY = ("label", "dim", "cell", "pb", "hb")


def _sides(table: pa.Table) -> tuple[pa.RecordBatch, pa.RecordBatch] | None:
    """Probes and homes of a block; None where a side is missing."""
    if not table.num_rows:
        return None
    batch = table.combine_chunks().to_batches()[0]
    is_home = batch.column("as_home").to_numpy(zero_copy_only=False)
    probes, homes = batch.filter(pa.array(~is_home)), batch.filter(pa.array(is_home))
    return (probes, homes) if probes.num_rows and homes.num_rows else None


def _open_pairs(probes: pa.RecordBatch, homes: pa.RecordBatch, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs that their codes leave open, STEP probes at a time."""

    def matrix(column: pa.Array, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)

    query, code = matrix(probes.column("query"), np.int8), matrix(homes.column("code"), np.uint8)
    signs = corners(code, query.shape[1])
    scale, off, factor = probes.column("scale").to_numpy(), probes.column("off").to_numpy(), homes.column("factor").to_numpy()
    vid_p, vid_h = probes.column("vid").to_numpy(), homes.column("vid").to_numpy()
    for a in range(0, len(query), STEP):
        some = slice(a, a + STEP)
        low = surely_below(estimates(query[some], scale[some], signs, factor), factor, off[some], threshold)
        i, j = np.nonzero(~low & (vid_p[some, None] != vid_h))
        yield i + a, j


def _undecided(threshold: float):
    """(block, vid, as_home) of the members of a block that have an open pair in it. Only codes come here."""

    def run(table: pa.Table) -> pa.Table:
        sides = _sides(table)
        vids, roles = [np.empty(0, np.int64)], [np.empty(0, np.bool_)]
        if sides:
            seen = [np.zeros(x.num_rows, np.bool_) for x in sides]
            for i, j in _open_pairs(*sides, threshold):
                seen[0][i], seen[1][j] = True, True
            for side, mine, role in zip(sides, seen, (False, True), strict=True):
                vids.append(side.column("vid").to_numpy()[mine])
                roles.append(np.full(int(mine.sum()), role))
        vid, role = np.concatenate(vids), np.concatenate(roles)
        key = {k: pa.array([table[k][0].as_py() if table.num_rows else None] * len(vid), table.schema.field(k).type) for k in _KEY}
        return pa.table(key | {"vid": vid, "as_home": role})

    return run


def _compare(threshold: float):
    """Counts of links and links that span them, for the undecided members of a block, whose vectors have come by now."""

    def run(table: pa.Table) -> pa.Table:
        sides = _sides(table)
        if not sides:
            return pa.table({"vid": np.empty(0, np.int64), "other": np.empty(0, np.int64), "links": np.empty(0, np.int64)})
        probes, homes = sides
        vid_p, vid_h = probes.column("vid").to_numpy(), homes.column("vid").to_numpy()
        copies = homes.column("copies").to_numpy()
        p, h = (_unit(_matrix(x.column("embedding"))) for x in (probes, homes))
        pairs = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for i, j in _open_pairs(probes, homes, threshold):
            for b in range(0, len(i), 100_000):
                i2, j2 = i[b : b + 100_000], j[b : b + 100_000]
                exact = np.einsum("ij,ij->i", p[i2], h[j2]) >= threshold
                pairs.append((i2[exact], j2[exact]))
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        links = np.bincount(i, weights=copies[j], minlength=len(vid_p)).astype(np.int64)
        top_p, top_h, before = vid_p.copy(), vid_h.copy(), None
        while before is None or (top_p != before).any():
            before = top_p.copy()
            np.minimum.at(top_h, j, top_p[i])
            np.minimum.at(top_p, i, top_h[j])
        linked_h = np.unique(j)
        some = links > 0
        return pa.table({
            "vid": np.concatenate([vid_p[some], vid_h[linked_h]]),
            "other": np.concatenate([top_p[some], top_h[linked_h]]),
            "links": np.concatenate([links[some], np.zeros(len(linked_h), np.int64)]),
        })

    return run


def embedding_components(vectors: DataFrame, threshold: float = 0.98, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector.

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine, in double precision, is at
    least threshold (0 < threshold <= 1). Null or zero vectors, and those that hold null, NaN or infinity, link with nothing.
    Equal vectors of a label (by two 64-bit hashes) are one class and count as links of each other; classes are compared once. Codes,
    factors and 8-bit queries are worked out once and stored; they alone go to the cells of the label's code in which a linked vector can
    live. Cells with many rows are compared in blocks of bounded size. A vector goes to a block only if its codes leave one of its pairs
    there open; each block returns counts and a spanning set of links, so no link is lost and no group is collected. Vectors of any
    length do. Other columns are not read, whatever their names. An empty table gives an empty result. Rows that repeat an id are rows of
    their own, each with its label, vector and links; rows that repeat all three are links of each other. Null ids are never the smallest: a
    component that has no other id has none.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(usable, F.lit(False)).alias("ok"), F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(seed), "embedding").alias("k2"))
    same = ["label", "k1", "k2"]
    classes = rows.filter("ok").groupBy(*same).agg(F.min("vec_id").cast("long").alias("first"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    # Classes get numbers of their own, written once with the codes: ids may be null or come twice.
    classes = classes.select("label", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("vid"), "k1", "k2", "copies", "embedding", "first")
    coded = stored(classes.mapInArrow(_codes(seed), _CODED.format(**kinds)), "codes", BATCH)
    numbers = coded.groupBy("label", "dim").agg(F.count("*").alias("n"))
    bits = numbers.select("label", "dim", F.greatest(F.lit(0), F.least(F.lit(CELL_BITS), "dim", F.ceil(F.log2(F.col("n") / CELL)))).cast("int").alias("bits"))
    light = coded.select("label", "dim", "vid", "copies", "code", "factor", "query", "scale", "off", "head")
    placed = light.join(bits, ["label", "dim"]).mapInArrow(
        _cells(threshold), f"label {kinds['label']}, dim int, vid long, copies long, code binary, factor double, query binary, scale double, off double, cell long, home boolean"
    )
    placed = stored(placed, "cells")
    key = ["label", "dim", "cell"]
    sizes = placed.groupBy(*key).agg(F.count("*").alias("probes"), F.count_if("home").alias("homes")).filter("homes > 0 and probes > 1")
    sizes = sizes.select(*key, F.ceil(F.col("probes") / PROBES).alias("np"), F.ceil(F.col("homes") / HOMES).alias("nh"))
    dealt = placed.join(sizes, key)
    own = F.xxhash64("vid")
    none = lambda kind: F.lit(None).cast(kind)
    as_probe = dealt.withColumn("pb", F.pmod(own, "np")).withColumn("hb", F.explode(F.sequence(F.lit(0), F.col("nh") - 1)))
    as_probe = as_probe.select(*_KEY, "vid", F.lit(False).alias("as_home"), none("binary").alias("code"), none("double").alias("factor"), "query", "scale", "off")
    as_home = dealt.filter("home").withColumn("hb", F.pmod(own, "nh")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("np") - 1)))
    as_home = as_home.select(*_KEY, "vid", F.lit(True).alias("as_home"), "code", "factor", none("binary").alias("query"), none("double").alias("scale"), none("double").alias("off"))
    schema = f"label {kinds['label']}, dim int, cell long, pb long, hb long, vid long, as_home boolean"
    undecided = stored(as_probe.union(as_home).groupBy(*_KEY).applyInArrow(_undecided(threshold), schema), "undecided")
    # Vectors come to those blocks alone that need them.
    whole = undecided.join(coded.select("vid", "copies", "embedding", "code", "factor", "query", "scale", "off"), "vid")
    found = stored(whole.groupBy(*_KEY).applyInArrow(_compare(threshold), "vid long, other long, links long"), "links")
    components = connected_components(found.select(F.col("vid").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("vid").agg(F.sum("links").alias("links"))
    members = components.withColumnRenamed("node", "vid").join(coded.select("vid", "first"), "vid")
    least = members.groupBy("component").agg(F.min("first").alias("least"))
    of = members.select("vid", "component").join(least, "component")
    named = coded.select(*same, "vid", "copies", "first").join(counts, "vid", "left").join(of, "vid", "left")
    component = F.when(F.col("component").isNotNull(), F.col("least")).otherwise(F.col("first"))
    named = named.select(*same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), component.alias("component"))
    joined = rows.filter("ok").select("vec_id", *same).join(named, same).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
