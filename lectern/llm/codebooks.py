"""Product codes of vectors in whole numbers: codebooks by Lloyd's rounds with Yinyang's group bounds, exact to the last tie."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import discard, fresh_path, stored

#: Vectors of a block, the unit in which vectors and their bounds are kept, and pairs of vectors and entries that are compared at a time.
BLOCK, PAIRS = 4096, 1_000_000
#: Entries that a group has about, and rounds of the clustering that forms groups. Groups change no result.
GROUP, GROUP_ROUNDS = 16, 5
#: Bounds are distances in double precision; they are this much looser than rounding can make them wrong.
SLACK = 1e-9


@dataclass
class Codebook:
    """The entries of one part, in whole numbers; which group each is in, and how far it has moved in the last round."""

    entries: np.ndarray
    group: np.ndarray
    moved: np.ndarray

    def group_moved(self) -> np.ndarray:
        out = np.zeros(int(self.group.max()) + 1)
        np.maximum.at(out, self.group, self.moved)
        return out


def grouped(entries: np.ndarray) -> np.ndarray:
    """Groups of entries that lie close together, numbered without gaps."""
    many = -(-len(entries) // GROUP)
    x = entries.astype(np.float64)
    centres = x[np.linspace(0, len(x) - 1, many).astype(int)]
    for _ in range(GROUP_ROUNDS):
        own = ((x[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[own == g].mean(axis=0) if (own == g).any() else centres[g] for g in range(many)])
    return np.unique(own, return_inverse=True)[1]


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """All squared distances between whole-number vectors, exactly: by a product of matrices where doubles hold it, else by differences."""
    top = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * top * top * max(1, points.shape[1]) < 2**52:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)).astype(np.int64)
    out = np.zeros((len(points), len(entries)), np.int64)
    for k in range(points.shape[1]):
        out += (points[:, k, None] - entries[:, k]) ** 2
    return out


def _rooted(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


def scan_all(points: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each point's nearest entry (ties to the lower index), its distance, and per group the least distance to an entry other than that."""
    groups = int(book.group.max()) + 1
    code, upper, lower = np.empty(len(points), np.int64), np.empty(len(points)), np.full((len(points), groups), np.inf)
    step = max(1, PAIRS // len(book.entries))
    for a in range(0, len(points), step):
        far = squared(points[a : a + step], book.entries)
        code[a : a + step] = own = far.argmin(axis=1)
        rows = np.arange(len(far))
        upper[a : a + step] = _rooted(far[rows, own])
        rest = _rooted(far)
        rest[rows, own] = np.inf
        for g in range(groups):
            lower[a : a + step, g] = rest[:, book.group == g].min(axis=1)
    return code, upper, lower


def rescan(points: np.ndarray, book: Codebook, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the entries have moved, from the code and bounds of before; also the number of distances worked out.

    A point's upper bound grows by what its entry has moved, a group's lower bound falls by what its entries have moved at most. Points whose
    upper bound stays below all groups keep their entry. For the others the distance to their own entry is worked out, and then those of
    the groups alone whose bound does not exclude them. Whole-number distances decide, ties to the lower index: a bound excludes a group
    only if it is greater, not if it is equal.
    """
    code, upper = code.copy(), (upper + book.moved[code]) * (1 + SLACK)
    lower = np.maximum(0, lower - book.group_moved()) * (1 - SLACK)
    worked, members = 0, [np.flatnonzero(book.group == g) for g in range(lower.shape[1])]
    doubtful = np.flatnonzero(upper >= lower.min(axis=1))
    step = max(1, PAIRS // max(len(book.entries), points.shape[1]))
    for a in range(0, len(doubtful), step):
        at = doubtful[a : a + step]
        own = ((points[at] - book.entries[code[at]]) ** 2).sum(axis=1)
        worked += len(at)
        upper[at] = _rooted(own)
        open_ = upper[at][:, None] * (1 + SLACK) >= lower[at]
        some = open_.any(axis=1)
        at, own, open_ = at[some], own[some], open_[some]
        far = np.full((len(at), len(book.entries)), np.iinfo(np.int64).max)
        for g, entries in enumerate(members):
            rows = np.flatnonzero(open_[:, g])
            far[rows[:, None], entries] = squared(points[at[rows]], book.entries[entries])
            worked += len(rows) * len(entries)
        rows = np.arange(len(at))
        far[rows, code[at]] = own
        code[at] = best = far.argmin(axis=1)
        upper[at] = _rooted(far[rows, best])
        # What is left bounds each group by entries other than the winner; an entry that lost its point may lie in a group not scanned.
        far[rows, best] = np.iinfo(np.int64).max
        least = _rooted(np.stack([far[:, entries].min(axis=1) for entries in members], axis=1))
        lower[at] = np.where(open_, least, np.minimum(lower[at], least))
    return code, upper, lower, worked


def _packed(dim: int, parts: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: list[np.ndarray]) -> dict:
    """A block's arrays as bytes. Bounds are rounded away from each other: upper ones up, lower ones down to 65,535 steps."""
    top = int(np.abs(parts).max(initial=0))
    flat = np.concatenate(lower, axis=1)
    step = max(1e-3, float(flat[np.isfinite(flat)].max(initial=0)) / 65535)
    raised = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
    return {"dim": dim, "n": len(parts), "wide": 2 if top < 2**15 else 4, "parts": parts.astype("<i2" if top < 2**15 else "<i4").tobytes(), "code": code.astype(np.uint16).tobytes(),
            "upper": raised.tobytes(), "lower": np.minimum(65535, np.floor(flat / step)).astype(np.uint16).tobytes(), "step": step}


_FIELDS = {"dim": pa.int32(), "n": pa.int32(), "wide": pa.int32(), "parts": pa.binary(), "code": pa.binary(), "upper": pa.binary(), "lower": pa.binary(), "step": pa.float64()}


def _points(row: dict, parts: int) -> np.ndarray:
    """A block's vectors as (vector, part, component)."""
    return np.frombuffer(row["parts"], f"<i{row['wide']}").astype(np.int64).reshape(row["n"], parts, -1)


class _Sums:
    """Sums and counts of the parts that each entry has, over all blocks of a task."""

    def __init__(self, books: list[Codebook]) -> None:
        self.total = [np.zeros((len(b.entries), b.entries.shape[1] + 1), np.int64) for b in books]

    def add(self, points: np.ndarray, code: np.ndarray) -> None:
        for k, total in enumerate(self.total):
            order = np.argsort(code[:, k], kind="stable")
            used, begin = np.unique(code[order, k], return_index=True)
            total[used, :-1] += np.add.reduceat(points[order, k], begin, axis=0)
            total[used, -1] += np.diff(np.append(begin, len(order)))


def _row_batch(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) if not isinstance(values.get(f.name), pa.Array) else values[f.name] for f in schema], schema=schema)


def _schema(label: pa.DataType) -> pa.Schema:
    return pa.schema([("block", pa.int64()), ("vec_ids", pa.list_(pa.int64())), ("labels", pa.list_(label)), *_FIELDS.items(), ("part", pa.int32()), ("sums", pa.binary())])


def _list_of(column: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def _ends(schema: pa.Schema, sums: _Sums) -> Iterator[pa.RecordBatch]:
    """A task's sums, a row for each part."""
    for k, total in enumerate(sums.total):
        yield _row_batch(schema, n=TaskContext.get().partitionId() % 64, part=k, sums=total.tobytes())


def _first(books: list[Codebook], parts: int):
    """Vectors to blocks with codes and bounds, and the sums of the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums, schema = TaskContext.get().partitionId() << 32, _Sums(books), None
        for batch in batches:
            schema = schema or _schema(batch.column(1).type)
            for a in range(0, batch.num_rows, BLOCK):
                some = batch.slice(a, BLOCK)
                numbers = some.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                points = np.floor(numbers * 1024).astype(np.int64).reshape(some.num_rows, parts, -1)
                code, upper, lower = (list(x) for x in zip(*[scan_all(points[:, k], b) for k, b in enumerate(books)], strict=True))
                code = np.stack(code, axis=1)
                sums.add(points, code)
                state = _packed(points.shape[1] * points.shape[2], points.reshape(len(points), -1), code, np.stack(upper, axis=1), lower)
                yield _row_batch(schema, block=block, vec_ids=_list_of(some.column(0)), labels=_list_of(some.column(1)), **state)
                block += 1
        if schema:
            yield from _ends(schema, sums)

    return run


def _again(row: dict, books: list[Codebook], parts: int) -> tuple[np.ndarray, list]:
    """A block's vectors, and the codes and bounds of each part after the entries have moved."""
    points = _points(row, parts)
    code = np.frombuffer(row["code"], np.uint16).reshape(row["n"], parts).astype(np.int64)
    upper = np.frombuffer(row["upper"], np.float32).reshape(row["n"], parts).astype(np.float64)
    widths = np.cumsum([int(b.group.max()) + 1 for b in books])
    lower = np.split(np.frombuffer(row["lower"], np.uint16).reshape(row["n"], -1) * row["step"], widths[:-1], axis=1)
    return points, [rescan(points[:, k], b, code[:, k], upper[:, k], lower[k]) for k, b in enumerate(books)]


def _numbers(batch: pa.RecordBatch) -> Iterator[tuple[int, dict]]:
    for i in range(batch.num_rows):
        yield i, {name: batch.column(name)[i].as_py() for name in _FIELDS}


def _next(books: list[Codebook], parts: int):
    """Blocks with the codes and bounds of one round more, and its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, schema = _Sums(books), None
        for batch in batches:
            schema = schema or _schema(batch.schema.field("labels").type.value_type)
            for i, row in _numbers(batch):
                points, found = _again(row, books, parts)
                code = np.stack([f[0] for f in found], axis=1)
                sums.add(points, code)
                state = _packed(row["dim"], points.reshape(len(points), -1), code, np.stack([f[1] for f in found], axis=1), [f[2] for f in found])
                yield _row_batch(schema, block=batch.column("block")[i].as_py(), vec_ids=batch.column("vec_ids").slice(i, 1), labels=batch.column("labels").slice(i, 1), **state)
        if schema:
            yield from _ends(schema, sums)

    return run


def _last(books: list[Codebook], parts: int):
    """A row per vector: its id, label, code and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in _numbers(batch):
                points, found = _again(row, books, parts)
                error = sum(((points[:, k] - b.entries[found[k][0]]) ** 2).sum(axis=1) for k, b in enumerate(books))
                code = np.stack([f[0] for f in found], axis=1)
                text = ["".join(f"{x:02x}" for x in c) for c in code.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("vec_ids")[i].values, batch.column("labels")[i].values, pa.array(text), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def _merged(state: DataFrame, books: list[Codebook]) -> list[np.ndarray]:
    """All tasks' sums, met in two steps; a table of parts x entries comes to the driver, whatever the number of vectors."""
    shapes = [(len(b.entries), b.entries.shape[1] + 1) for b in books]

    def merge(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py(), np.int64) for x in group["sums"]], axis=0)
        return pa.table({"part": pa.array([group["part"][0].as_py()], pa.int32()), "n": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "part int, n int, sums binary"
    rows = state.filter("sums IS NOT NULL").select("part", "n", "sums")
    rows = rows.groupBy("part", "n").applyInArrow(merge, kind).groupBy("part").applyInArrow(merge, kind).collect()
    return [np.frombuffer(r["sums"], np.int64).reshape(shapes[r["part"]]) for r in sorted(rows, key=lambda r: r["part"])]


def moved(book: Codebook, sums: np.ndarray) -> Codebook:
    """Entries at the floors of their parts' means; those without parts stay."""
    used = sums[:, -1] > 0
    entries = np.where(used[:, None], sums[:, :-1] // np.maximum(1, sums[:, -1:]), book.entries)
    return Codebook(entries, book.group, _rooted(((entries - book.entries) ** 2).sum(axis=1)))


def product_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row per vector that is used.

    Components become floor(1024 x), vectors `parts` equal consecutive parts. The codebook of a part starts with that part of the `entries`
    smallest vec_ids (at most 256; null ids last, ties by the vectors; fewer if there are fewer vectors), and in each round entries move to
    the floors of the means of the parts next to them. error: squared distance to the final entries; label_error: its sum over equal
    labels, nulls together; codebooks_sha256: of all final entries.

    Vectors that are null or hold null or non-finite components are dropped, and so are those whose length is not a positive multiple of
    `parts` or differs from that of the smallest vec_id, and those with components so large (2^20 / sqrt(length)) that a distance would not
    fit a long. Repeated rows count each. Columns of other names are not read. An empty table gives no rows.

    Each round is one pass over blocks of vectors that carry their codes and bounds, with no shuffle but that of sums per task; a block is
    rewritten as the bounds change, and the round before it is deleted. See rescan() for what a round leaves out.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes are bytes: 1 to 256 entries")
    spark = vectors.sparkSession
    limit = F.lit(float(2**20)) / F.sqrt(F.size("embedding"))
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")).filter(usable).filter(fits)
    # At most 256 vectors.
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(entries).collect()
    dim = len(start[0][0]) if start else parts
    start = rows.filter(F.size("embedding") == dim).orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(entries).collect() if any(len(r[0]) != dim for r in start) else start
    kind = rows.schema["label"].dataType.simpleString()
    result = f"vec_id long, label {kind}, code string, error long"
    if not start:
        empty = spark.createDataFrame([], result)
        return empty.select("vec_id", "code", "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    whole = np.floor(np.array([r[0] for r in start]) * 1024).astype(np.int64).reshape(len(start), parts, -1)
    books = [Codebook(whole[:, k], grouped(whole[:, k]), np.zeros(len(whole))) for k in range(parts)]
    schema = f"block long, vec_ids array<long>, labels array<{kind}>, dim int, n int, wide int, parts binary, code binary, upper binary, lower binary, step double, part int, sums binary"
    step, path = rows.filter(F.size("embedding") == dim).mapInArrow(_first(books, parts), schema), None
    for _ in range(rounds):
        before, path = path, fresh_path(spark, "codebooks")
        state = stored(step, "codebooks", path=path)
        if before:
            discard(spark, before)
        books = [moved(b, s) for b, s in zip(books, _merged(state, books), strict=True)]
        step = state.filter("block IS NOT NULL").mapInArrow(_next(books, parts), schema)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.entries.ravel().tolist()).encode()).hexdigest()
    found = stored(state.filter("block IS NOT NULL").mapInArrow(_last(books, parts), result), "codes")
    discard(spark, path)
    totals = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")
    joined = found.join(totals, F.col("label").eqNullSafe(F.col("l")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
