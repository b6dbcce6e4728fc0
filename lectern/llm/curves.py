"""Nearest neighbours by several shifted Hilbert orderings of projected vectors, and the proof that none nearer was missed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import stored

#: Projected coordinates of a curve and bits of each: a key is a long.
DIMS, BITS = 8, 7
#: Vectors from which the middle and the width of the space are taken; they place the curves and change no result.
SAMPLE = 10_000
#: Vectors of a block, queries of a group, and blocks whose balls are compared with all groups in one task.
BLOCK, GROUP, BALLS = 2048, 1024, 1024
#: Vectors in a batch between the JVM and Python, and blocks.
BATCH, FEW = 2000, 4
#: Slack, relative to the vectors' lengths, for rounding in bounds; pairs within it are decided by their exact distance.
SLACK = 1e-9


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of whole coordinates below 2^bits, by turning axes and Gray codes bit by bit."""
    x = [c.astype(np.int64) for c in cells.T]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(len(x)):
            high = (x[i] >> level & 1).astype(np.bool_)
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0]) ^ swap
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    key = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | ((axis ^ turn) >> level & 1)
    return key


@lru_cache(maxsize=64)
def _directions(size: int, curve: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A curve's orthonormal directions and its shift."""
    rng = np.random.default_rng([seed, size, curve])
    q, _ = np.linalg.qr(rng.standard_normal((size, min(size, DIMS))))
    return q, rng.random(q.shape[1])


def curve_keys(x: np.ndarray, middle: np.ndarray, width: float, curve: int, seed: int) -> np.ndarray:
    """Keys of vectors on one curve. Coordinates within four widths of the middle fill half of the cube, which the shift moves about."""
    q, shift = _directions(x.shape[1], curve, seed)
    place = np.clip(((x - middle) @ q) / (8 * width) + 0.5, 0, 1 - 1e-9)
    return hilbert_keys(((place + shift) / 2 * (1 << BITS)).astype(np.int64), BITS)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of pairs, row by row."""
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def _placed(frames: dict[int, tuple[np.ndarray, float]], curves: int, seed: int):
    """Each class of vectors once for each curve, with its key there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for size in np.unique(sizes).tolist():
                some = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x = _matrix(some.column("embedding"))
                middle, width = frames.get(size, (np.zeros(size), 1.0))
                for curve in range(curves):
                    keys = curve_keys(x, middle, width, curve, seed)
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(x), curve, np.int32)), pa.array(keys)], names=[*some.schema.names, "curve", "key"])

    return run


_FOUND = "q1 long, q2 long, c1 long, c2 long, ids array<long>, score double"


def _found(q: tuple, classes: pa.RecordBatch, rows: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    at = pa.array(rows)
    columns = [pa.array(q[0], pa.int64()), pa.array(q[1], pa.int64()), *(classes.column(c).take(at) for c in ("k1", "k2", "ids")), pa.array(score)]
    return pa.RecordBatch.from_arrays(columns, names=["q1", "q2", "c1", "c2", "ids", "score"])


def _nearest(score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The places of the k least scores, ties to the smaller first id."""
    return np.lexsort((first, score))[:k]


def _first_ids(classes: pa.RecordBatch) -> np.ndarray:
    lists = classes.column("ids")
    return lists.flatten().fill_null(2**63 - 1).to_numpy()[lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]]


def _windows(window: int, k: int):
    """Over rows in the order of (curve, dim, key): each query's k + 1 nearest classes among `window` neighbours on either side."""

    def search(rows: pa.RecordBatch, begin: int, end: int) -> Iterator[pa.RecordBatch]:
        asks = np.flatnonzero(rows.column("asks").to_numpy(zero_copy_only=False))
        space = rows.column("curve").to_numpy().astype(np.int64) << 32 | rows.column("dim").to_numpy()
        k1, k2, firsts, lists = rows.column("k1").to_numpy(), rows.column("k2").to_numpy(), _first_ids(rows), rows.column("embedding")
        for i in asks[(asks >= begin) & (asks < end)].tolist():
            near = np.arange(max(0, i - window), min(rows.num_rows, i + window + 1))
            near = near[space[near] == space[i]]
            x = _matrix(lists.slice(int(near[0]), len(near)))
            score = distances(x, x[i - near[0]])
            best = _nearest(score, firsts[near], k + 1)
            yield _found(([k1[i]] * len(best), [k2[i]] * len(best)), rows, near[best], score[best])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, 0  # rows up to `done` have been searched
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            end = max(done, held.num_rows - window)
            yield from search(held, done, end)
            cut = max(0, end - window)
            held, done = held.slice(cut), end - cut
        if held is not None:
            yield from search(held, done, held.num_rows)

    return run


def _ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    middle = x.mean(axis=0)
    return middle, float(distances(x, middle).max()) * (1 + SLACK)


def _by_space(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most `size` rows of one length of vectors."""
    dims = batch.column("dim").to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for c in range(a, b, size):
            yield batch.slice(c, min(size, b - c))


def _list_of(column: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def _balls(size: int, fields: list[str], reach: bool):
    """Rows to blocks of neighbours on the curve: their columns as lists, their vectors in one list, and a ball around them.

    reach: the largest radius that the block's queries ask for; null where it holds no queries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in _by_space(batch, size):
                x = _matrix(some.column("embedding"))
                middle, radius = _ball(x)
                most = float(np.max(some.column("r").to_numpy())) if reach else None
                lists = [_list_of(some.column(f)) for f in fields]
                vectors = _list_of(some.column("embedding").flatten())
                yield pa.RecordBatch.from_arrays([some.column("dim").slice(0, 1), pa.array([block]), pa.array([middle.tolist()]), pa.array([radius]), pa.array([most], pa.float64()), vectors, *lists], names=["dim", "block", "middle", "radius", "reach", "vectors", *fields])
                block += 1

    return run


def _open_pairs(table: pa.Table) -> pa.Table:
    """Of groups of queries and blocks of vectors the pairs whose balls come near enough."""
    is_group = table["reach"].is_valid().to_numpy(zero_copy_only=False)
    groups, blocks = table.filter(pa.array(is_group)), table.filter(pa.array(~is_group))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if groups.num_rows and blocks.num_rows:
        middles = np.array(blocks["middle"].to_pylist())
        ids, radius = blocks["block"].to_numpy(), blocks["radius"].to_numpy()
        for g in range(groups.num_rows):
            own = np.array(groups["middle"][g].as_py())
            gap = distances(middles, own) - radius - groups["radius"][g].as_py()
            near = ids[gap - SLACK * (1 + np.abs(middles).max() + np.abs(own).max()) <= groups["reach"][g].as_py()]
            left.append(np.full(len(near), groups["block"][g].as_py()))
            right.append(near)
    group, block = np.concatenate(left), np.concatenate(right)
    return pa.table({"dim": pa.array(np.full(len(group), table["dim"][0].as_py()), pa.int32()), "group": group.astype(np.int64), "block": block.astype(np.int64)})


def _scan(k: int):
    """Compares a group of queries with a block: each query's k + 1 nearest classes there, as far as they are within its radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                dim = row["dim"].as_py()
                x, q = (row[c].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) for c in ("vectors", "asked"))
                r = row["rs"].values.to_numpy()
                classes = pa.RecordBatch.from_arrays([row[c].values for c in ("k1", "k2", "ids")], names=["k1", "k2", "ids"])
                q1, q2, firsts = row["q1"].values.to_numpy(), row["q2"].values.to_numpy(), _first_ids(classes)
                slack = SLACK * max(1.0, float((x * x).sum(axis=1).max()), float((q * q).sum(axis=1).max()))
                near = np.flatnonzero(distances(q, np.array(row["middle"].as_py())) - row["radius"].as_py() - slack <= r)
                square = (q[near] ** 2).sum(axis=1)[:, None] - 2 * (q[near] @ x.T) + (x * x).sum(axis=1)
                open_ = square <= (r[near] ** 2)[:, None] + slack
                found = []
                for a in np.flatnonzero(open_.any(axis=1)).tolist():
                    rows = np.flatnonzero(open_[a])
                    score = distances(x[rows], q[near[a]])
                    rows, score = rows[score <= r[near[a]]], score[score <= r[near[a]]]
                    best = _nearest(score, firsts[rows], k + 1)
                    found.append((np.full(len(best), near[a]), rows[best], score[best]))
                if found:
                    who, rows, score = (np.concatenate(c) for c in zip(*found, strict=True))
                    yield _found((q1[who], q2[who]), classes, rows, score)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """(q1, q2, best): each query's k + 1 nearest rows of those found. A class found twice counts once; its rows count each."""
    once = found.groupBy("q1", "q2", "c1", "c2").agg(F.min("score").alias("score"), F.first("ids").alias("ids"))
    rows = F.transform("ids", lambda i: F.struct(F.col("score").alias("score"), F.coalesce(i, F.lit(2**63 - 1)).alias("order"), i.alias("vec_id"), F.col("c1").alias("c1"), F.col("c2").alias("c2")))
    return once.select("q1", "q2", rows.alias("rows")).groupBy("q1", "q2").agg(F.slice(F.array_sort(F.flatten(F.collect_list("rows"))), 1, k + 1).alias("best"))


def nearest(vectors: DataFrame, asks: Column, k: int = 10, curves: int = 3, window: int = 64, complete: bool = True, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `asks` holds, its k nearest other rows by Euclidean distance, ties to the smaller id.

    Vectors are projected to a few random directions and ordered by their place on a Hilbert curve, once for each curve, each with its
    own directions and shift. A query is compared with `window` neighbours on either side in each order; what is found merges and is
    ranked by exact distances. That alone is an approximation, whose recall falls with the number of dimensions in which the data are spread.
    complete: the k-th distance found so far is a bound, and blocks of the first order that lie farther from a query than it are left
    out for certain; the others are compared, so that the result is exact. Queries go to blocks in groups.

    Null and zero vectors, and those with null or non-finite components, take no part. Only vectors of the query's length are candidates.
    Equal vectors are one class, of which the k + 1 smallest ids are kept: no more can be among anyone's nearest. A query's own row is
    left out once, so rows that repeat id and vector are each other's neighbours. Null ids come last in ties. Tables without queries or
    vectors give no rows; queries with fewer candidates than k give them all. Columns of other names are not read.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("embedding").isNotNull()).filter(finite & F.exists("embedding", lambda x: x != 0))
    rows = rows.withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(seed), "embedding")})
    kind = rows.schema["embedding"].dataType.simpleString()
    queries = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "k1", "k2")
    nth = F.row_number().over(Window.partitionBy("k1", "k2", "embedding").orderBy(F.asc_nulls_last("vec_id")))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("nth", "vec_id"))), lambda x: x.vec_id)
    classes = few.groupBy("k1", "k2", "embedding").agg(ids.alias("ids"))
    asked = queries.select("k1", "k2", F.lit(True).alias("asks")).distinct()
    classes = classes.join(asked, ["k1", "k2"], "left").select("k1", "k2", "ids", F.coalesce("asks", F.lit(False)).alias("asks"), "embedding", F.size("embedding").alias("dim"))
    classes = stored(classes, "classes")
    # A bounded sample, by hash.
    taken: dict[int, list] = {}
    for r in classes.orderBy("k1").select("embedding").limit(SAMPLE).collect():
        taken.setdefault(len(r[0]), []).append(r[0])
    frames = {}
    for size, some in taken.items():
        x = np.array(some, np.float64)
        middle = x.mean(axis=0)
        frames[size] = (middle, float(np.sqrt(np.mean((x - middle) ** 2))) or 1.0)
    fields = f"k1 long, k2 long, ids array<long>, asks boolean, embedding {kind}, dim int"

    def along(many: int) -> DataFrame:
        order = ["curve", "dim", "key", "k1", "k2"]
        placed = classes.mapInArrow(_placed(frames, many, seed), f"{fields}, curve int, key long")
        return placed.repartitionByRange(*order).sortWithinPartitions(*order)

    found = stored(along(curves).mapInArrow(_windows(window, k), _FOUND), "windows", BATCH)
    best = _best(found, k)
    if complete:
        best = stored(best, "near")
        radius = F.when(F.size("best") > k, F.element_at("best", k + 1).score).otherwise(F.lit(float("inf")))
        first = along(1)
        blocks = stored(first.mapInArrow(_balls(BLOCK, ["k1", "k2", "ids"], False), f"dim int, block long, middle array<double>, radius double, reach double, vectors {kind}, k1 array<long>, k2 array<long>, ids array<array<long>>"), "blocks", BLOCK)
        within = classes.filter("asks").mapInArrow(_placed(frames, 1, seed), f"{fields}, curve int, key long").join(best.select(F.col("q1").alias("k1"), F.col("q2").alias("k2"), radius.alias("r")), ["k1", "k2"])
        within = within.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), "dim", "key", "embedding", "r").repartitionByRange("dim", "key", "q1").sortWithinPartitions("dim", "key", "q1")
        groups = stored(within.mapInArrow(_balls(GROUP, ["q1", "q2", "r"], True), f"dim int, block long, middle array<double>, radius double, reach double, vectors {kind}, q1 array<long>, q2 array<long>, r array<double>"), "groups", GROUP)
        # Balls only: every task has some blocks and all groups of one length.
        share = max(1, -(-blocks.count() // BALLS))
        ball = ["dim", "block", "middle", "radius", "reach"]
        balls = blocks.select(*ball, F.pmod(F.xxhash64("block"), F.lit(share)).alias("share")).union(groups.select(*ball, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(share - 1).cast("long"))).alias("share")))
        pairs = balls.groupBy("dim", "share").applyInArrow(_open_pairs, "dim int, group long, block long")
        asked = groups.select("dim", F.col("block").alias("group"), "q1", "q2", F.col("r").alias("rs"), F.col("vectors").alias("asked"))
        whole = pairs.join(blocks.drop("reach"), ["dim", "block"]).join(asked, ["dim", "group"])
        nearer = stored(whole.mapInArrow(_scan(k), _FOUND), "scanned", FEW)
        best = _best(found.union(nearer), k)
    # A class's k + 1 nearest rows hold one row that may be the query's own.
    own = F.transform(F.filter(F.transform("best", lambda b, i: F.struct(i.alias("at"), b.alias("b"))), lambda x: (x.b.c1 == F.col("k1")) & (x.b.c2 == F.col("k2")) & x.b.vec_id.eqNullSafe(F.col("query_id"))), lambda x: x["at"])
    result = queries.join(best.select(F.col("q1").alias("k1"), F.col("q2").alias("k2"), "best"), ["k1", "k2"]).withColumn("own", F.coalesce(F.try_element_at(own, F.lit(1)), F.lit(-1)))
    others = F.slice(F.filter("best", lambda b, i: i != F.col("own")), 1, k)
    result = result.select("query_id", F.posexplode(others).alias("at", "b"))
    return result.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
