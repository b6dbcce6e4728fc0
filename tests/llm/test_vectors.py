import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm.codebooks import Codebook, grouped, moved, product_codes, rescan, scan_all, squared
from lectern.llm.curves import hilbert_keys, nearest

VECTORS = "vec_id long, embedding array<float>, label string, block int, k1 string, dim int, n int, error int, sums int, key int"
REST = (1, "x", 1, 1, 1, 1, 1)


def vectors(n=700, dim=8, seed=2, copies=150):
    """Clusters, copies of one vector, ties, repeated rows, null ids, and vectors that take no part."""
    r = random.Random(seed)
    g = np.random.default_rng(seed)
    centres = g.standard_normal((12, dim))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 12] + 0.2 * g.standard_normal(dim)], r.choice(["a", "b", None])) for k in range(n)]
    rows += [(n + k, rows[5][1], "a") for k in range(copies)]
    rows += [(n + copies + k, [float(v) for v in ([1.0] + [0.0] * (dim - 1) if k % 2 else [0.0] * (dim - 1) + [1.0])], "b") for k in range(40)]
    rows += [rows[7], rows[7], (rows[9][0], rows[10][1], "c"), (None, rows[11][1], None), (None, rows[11][1], "a")]
    bad = [None, [0.0] * dim, [], [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0] * (dim + 1)]
    rows += [(5000 + 100 * k, v, "a") for k, v in enumerate(bad)]
    r.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, *REST) for r in rows], VECTORS)


def plain_codes(rows, parts, entries, rounds):
    ok = [r for r in rows if r[1] and len(r[1]) % parts == 0 and all(x is not None and np.isfinite(x) for x in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    x = np.array([[int(np.floor(1024 * v)) for v in r[1]] for r in ok], object)
    p = x.reshape(len(x), parts, -1)
    books = [[list(v) for v in p[:entries, k]] for k in range(parts)]

    def near(k):
        c = np.array(books[k], object)
        far = ((p[:, k, None, :] - c[None]) ** 2).sum(axis=2)
        return far.argmin(axis=1), far.min(axis=1)

    for _ in range(rounds):
        for k in range(parts):
            own, _ = near(k)
            for e in range(len(books[k])):
                some = p[own == e, k]
                if len(some):
                    books[k][e] = [int(s) // len(some) for s in some.sum(axis=0)]
    last = [near(k) for k in range(parts)]
    error = [int(sum(last[k][1][i] for k in range(parts))) for i in range(len(ok))]
    by_label = Counter()
    for r, e in zip(ok, error, strict=True):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return Counter((r[0], "".join(f"{last[k][0][i]:02x}" for k in range(parts)), error[i], by_label[r[2]], digest) for i, r in enumerate(ok))


@pytest.mark.parametrize("entries,rounds", [(256, 4), (20, 6), (1, 2)])
def test_product_codes(spark, entries, rounds):
    rows = vectors()
    got = Counter(tuple(r) for r in product_codes(table(spark, rows).repartition(5), 4, entries, rounds).collect())
    assert got == plain_codes(rows, 4, entries, rounds)


def test_product_codes_of_few_vectors(spark):
    assert product_codes(table(spark, vectors()).limit(0)).collect() == []
    assert product_codes(table(spark, [(1, None, "a"), (2, [1.0, 2.0], "a"), (3, [1e30] * 4, "a")])).collect() == []
    rows = [(1, [-0.0001, 0.5, -3.25, 100.0], None), (2, [0.0, 0.5, -3.5, 900.0], None), (None, [0.25, 0.5, -3.25, 100.0], "a")]
    assert Counter(tuple(r) for r in product_codes(table(spark, rows)).collect()) == plain_codes(rows, 4, 256, 4)


def test_bounds_leave_out_work_and_nothing_else():
    g = np.random.default_rng(1)
    points = np.floor(200 * g.standard_normal((3000, 4)) + 2000 * g.integers(0, 6, (3000, 1))).astype(np.int64)
    points[100:200] = points[100]
    entries = points[:128].copy()
    entries[40] = entries[3]
    book = Codebook(entries, grouped(entries), np.zeros(128))
    code, upper, lower = scan_all(points, book)
    done = []
    for _ in range(8):
        sums = np.zeros((128, 5), np.int64)
        np.add.at(sums, code, np.hstack([points, np.ones((3000, 1), np.int64)]))
        book = moved(book, sums)
        code, upper, lower, worked = rescan(points, book, code, upper, lower)
        assert (code == squared(points, book.entries).argmin(axis=1)).all()
        done.append(worked / (3000 * 128))
    assert done[-1] < 0.15 and sum(done) < 0.5 * len(done)


def test_distances_of_large_numbers():
    p, e = np.array([[2**28, -(2**28)], [5, 7]]), np.array([[-(2**28), 2**28 - 1], [5, 6]])
    assert squared(p, e).tolist() == [[int(((a.astype(object) - b.astype(object)) ** 2).sum()) for b in e] for a in p]


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_hilbert_order_moves_by_one_step(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def plain_nearest(rows, every, k):
    ok = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(x != 0 for x in r[1])]
    out = Counter()
    for i, q in enumerate(ok):
        if q[0] is None or q[0] % every:
            continue
        others = [(float(np.sqrt(((np.array(q[1]) - np.array(c[1])) ** 2).sum())), c[0] is None, c[0] or 0, c[0]) for j, c in enumerate(ok) if j != i and len(c[1]) == len(q[1])]
        out.update((q[0], rank, c[3], round(c[0], 9)) for rank, c in enumerate(sorted(others)[:k], 1))
    return out


@pytest.mark.parametrize("k,window", [(10, 64), (3, 1)])
def test_nearest(spark, k, window):
    rows = vectors()
    rows += [(9900, [1.0, 2.0], "a"), (9901, [1.0, 3.0], "a")]
    found = nearest(table(spark, rows).repartition(4), F.col("vec_id") % 5 == 0, k=k, window=window)
    assert Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found.collect()) == plain_nearest(rows, 5, k)


def test_windows_alone(spark):
    """Recall of the curves without the proof, in three dimensions and in clusters."""
    g = np.random.default_rng(8)
    rows = [(k, [float(x) for x in v], "a") for k, v in enumerate(g.random((3000, 3)))]
    want = plain_nearest(rows, 20, 10)
    got = Counter((r.query_id, r.vec_id) for r in nearest(table(spark, rows), F.col("vec_id") % 20 == 0, complete=False).collect())
    true = {(q, v) for q, _, v, _ in want}
    assert len(true & set(got)) / len(true) > 0.9


def test_nearest_of_nothing(spark):
    some = table(spark, vectors(20, copies=3))
    assert nearest(some.limit(0), F.col("vec_id") % 5 == 0).collect() == []
    assert nearest(some, F.lit(False)).collect() == []
    assert nearest(table(spark, [(100, [1.0], "a")]), F.col("vec_id") % 100 == 0).collect() == []
