import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from lectern.llm.embedding_dedup import corners, embedding_components, encode, estimates, rotated, surely_below
from lectern.llm.exact_dedup import exact_dedup
from lectern.llm.graph import connected_components
from lectern.llm.gray_index import build_index, near_links
from lectern.llm.simhash import fingerprint, simhash_components
from tests.llm.helpers import frame, texts

A = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(nodes, links):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in nodes}


def test_exact_dedup(spark):
    rows = texts()
    got = exact_dedup(frame(spark, rows)).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(A)].append(r[0])
    assert len(got) == len(rows)
    want = []
    for t, ids in groups.items():
        keep = max((x for x in ids if x is not None), default=None)
        want += [(x, keep, len(ids), x == keep, hashlib.sha256(t.encode()).hexdigest()) for x in ids]
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert exact_dedup(frame(spark, [])).count() == 0


def test_components(spark):
    r = random.Random(1)
    chain = [(k, k + 1) for k in range(0, 300)]
    hub = [(1000, k) for k in range(1001, 1400)]
    other = [(r.randint(2000, 2600), r.randint(2000, 2600)) for _ in range(300)]
    edges = chain + hub + other + [(5, 5)]
    r.shuffle(edges)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == brute_components(nodes, edges)
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
    words = connected_components(spark.createDataFrame([("b", "a"), ("c", "b"), (None, "z")], "a string, b string")).collect()
    assert {x.node: x.component for x in words} == {"a": "a", "b": "a", "c": "a"}


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_gray_index(spark, radius):
    r = random.Random(radius)
    prints = [r.getrandbits(64) for _ in range(400)]
    for p in prints[:120]:
        for _ in range(3):
            q = p
            for _ in range(r.randint(1, 3)):
                q ^= 1 << r.randrange(64)
            prints.append(q)
    prints = list(set(prints) | {0, 1, 2**63, 2**64 - 1})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    table = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = [(x.a, x.b) for x in near_links(table, radius, fanout=8).collect()]
    for a, b in links:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= radius
    true = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius]
    assert brute_components(signed, links) == brute_components(signed, true)


def test_gray_levels(spark):
    levels = build_index(spark.range(500).selectExpr("id as fp"), fanout=8)
    assert levels[-1].count() == 1 and levels[0].selectExpr("sum(size(kids)) as n").first().n == 500


def brute_fingerprint(t, k=3):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(A))
    if not w:
        return 0
    runs = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, monkeypatch):
    rows = texts()
    got = simhash_components(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = [(r[0], brute_fingerprint(r[1])) for r in rows]
    assert sorted((x.doc_id if x.doc_id is not None else -1, x.fp & (2**64 - 1)) for x in got) == sorted((d if d is not None else -1, f) for d, f in prints)
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i][1] ^ prints[j][1]).bit_count() <= 2]
    comp = brute_components(range(len(prints)), links)
    least = defaultdict(list)
    for i, c in comp.items():
        least[c].append(prints[i][0])
    want = sorted((prints[i][0] if prints[i][0] is not None else -1, min((x for x in least[c] if x is not None), default=-1)) for i, c in comp.items())
    assert sorted((x.doc_id if x.doc_id is not None else -1, x.component_id if x.component_id is not None else -1) for x in got) == want
    assert simhash_components(frame(spark, [])).count() == 0
    import lectern.llm.simhash as m

    monkeypatch.setattr(m, "_STEP", 7)
    for r in rows:
        assert fingerprint(r[1] or "") == brute_fingerprint(r[1])


def test_embeddings(spark, monkeypatch):
    import lectern.llm.embedding_dedup as m

    for name, value in (("CELL", 4), ("HOMES", 16), ("PROBES", 32), ("STEP", 10)):
        monkeypatch.setattr(m, name, value)
    rng = np.random.default_rng(0)
    base = rng.standard_normal((150, 16))
    rows = [base[k] for k in range(150)]
    for k in range(60):
        rows.append(base[k % 20] + rng.standard_normal(16) * rng.choice([0.02, 0.05, 0.1, 0.2]))
    rows += [rows[3], rows[3], rows[4] * 2]
    data = [(k, [float(np.float32(x)) for x in v], k % 2 if k % 17 else 0) for k, v in enumerate(rows)]
    n = len(data)
    data += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [1.0, None], 0), (n + 4, data[5][1], None), (n + 5, [float("inf")] * 16, 1), (n + 6, [3.0], 1), (n + 7, [2.0], 1), (n + 8, [], 0)]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_components(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"), 0.98).collect()}
    ok = {k: (np.array(v), lab) for k, v, lab in data if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = []
    for a, (x, la) in ok.items():
        for b, (y, lb) in ok.items():
            if a != b and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links.append((a, b))
    comp = brute_components([d[0] for d in data], links)
    assert got == {k: (sum(a == k for a, _ in links), comp[k], comp[k] == k) for k in comp}
    assert embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embedding_extras(spark):
    """Columns with inner names, vectors of doubles and of great length, repeated rows, and recall 1 on queries against all rows."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 24))
    rows = [(k, (base[k % 40] + rng.standard_normal(24) * 0.03 * (k % 5)).tolist(), 1) for k in range(200)]
    wide = rng.standard_normal(20_000).tolist()
    rows += [(300, wide, 1), (301, [x * 3 for x in wide], 1), (302, [-x for x in wide], 1), (7, rows[7][1], 1), (None, rows[9][1], 1)]
    names = ["vid", "k1", "k2", "code", "factor", "dim", "cell", "n_links", "ok"]
    df = spark.createDataFrame([(*r, *names) for r in rows], "vec_id long, embedding array<double>, label int, " + ", ".join(f"{n} string" for n in names))
    got = embedding_components(df).collect()
    assert len(got) == len(rows)
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    close = lambda i: sum(j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98 for j in range(len(rows)))
    want = sorted((r[0] if r[0] is not None else -1, close(i)) for i, r in enumerate(rows))
    assert sorted((x.vec_id if x.vec_id is not None else -1, x.n_links) for x in got) == want


def test_rotations():
    rng = np.random.default_rng(8)
    for dim in (3, 512, 513, 3000):
        x = rng.standard_normal((6, dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
        y = rotated(x, 7)
        np.testing.assert_allclose(x @ x.T, y @ y.T, atol=1e-9)
        assert abs(np.abs(encode(x, 7)["factor"]).mean() - np.sqrt(2 / np.pi)) < (0.2 if dim == 3 else 0.03)


def test_estimates():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((50, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = x + rng.standard_normal(x.shape) * 0.01
    q /= np.linalg.norm(q, axis=1)[:, None]

    def guess(seed):
        asked, coded = encode(q, seed), encode(x, seed)
        return estimates(asked["query"], asked["scale"], corners(coded["code"], asked["query"].shape[1]), coded["factor"]), coded["factor"], asked["off"]

    assert np.abs(np.mean([guess(seed)[0] for seed in range(300)], axis=0) - q @ x.T).max() < 0.05  # no bias
    assert encode(x, 7)["code"].shape == (50, 8) and encode(x, 7)["query"].dtype == np.int8
    low = surely_below(*guess(7), 0.98)
    assert not (low & (q @ x.T >= 0.98)).any()  # no link is lost
    assert low.mean() > 0.9  # most others need no exact product


def test_embedding_ids(spark):
    """Null ids, and ids that come twice: rows are told apart by themselves, not by their ids."""
    a, b, c, d = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.99, 0.1, 0.0]
    rows = [(1, a, 1), (1, b, 1), (2, d, 1), (3, [0.1, 0.99, 0.0], 1), (None, c, 1), (None, c, 1), (7, c, 2), (7, a, 2), (9, d, 2), (5, a, 3), (5, [0.999, 0.01, 0.0], 3), (None, b, 4), (8, [0.0, 2.0, 0.1], 4)]
    found = embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.98)
    got = sorted((x.vec_id or -1, x.n_links, x.component_id or -1, x.kept) for x in found.collect())
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (-1, 1, -1, True), (-1, 1, -1, True), (7, 0, 7, True), (7, 1, 7, True), (9, 1, 7, False), (5, 1, 5, True), (5, 1, 5, True), (-1, 1, 8, False), (8, 1, 8, True)]
    assert got == sorted(want)
