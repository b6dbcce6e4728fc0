from collections import Counter, defaultdict

import corpus_pipeline as P
import pytest

from lectern.llm.simhash import fingerprint
from tests.llm.helpers import frame, texts
from tests.llm.test_dedup import A, brute_components

ROWS = [(d, t, lang or "en", s) for d, t, lang, s in texts()] + [(None, "no id", "en", "b"), (None, "another without id", "fr", None), (700, "123 45 !!", "en", "a")]


def table(spark, rows, clash=True):
    df = frame(spark, rows)
    from pyspark.sql import functions as F

    return df.withColumn("language", F.lit(1)).withColumn("weird name", F.lit(2)) if clash else df


def known(rows):
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in rows), key=repr)


def test_language(spark):
    got = P.language_stage(spark, table(spark, ROWS), "").collect()
    want = [(d, t, lang, s) for d, t, lang, s in ROWS if any(c.isalpha() for c in t or "")]
    assert known(got) == sorted(((d if d is not None else -1, t) for d, t, *_ in want), key=repr)
    assert got[0]["weird name"] == 2 and got[0]["language"] == 1


def test_exact(spark):
    got = P.exact_stage(spark, table(spark, ROWS), "").collect()
    groups = defaultdict(list)
    for d, t, *_ in ROWS:
        groups[(t or "").translate(A)].append(d)
    want = sorted((max((x for x in ids if x is not None), default=-1), t) for t, ids in groups.items())
    assert sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "").translate(A)) for r in got) == want


def test_near(spark):
    rows = list({(d, t): (d, t, lang, s) for d, t, lang, s in ROWS}.values())
    got = P.near_stage(spark, table(spark, rows), "").collect()
    prints = [fingerprint(t or "") for _, t, *_ in rows]
    comp = brute_components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    members = defaultdict(list)
    for i, c in comp.items():
        members[c].append(rows[i][0])
    ids = Counter(min((x for x in m if x is not None), default=-1) for m in members.values())
    assert Counter(r.doc_id if r.doc_id is not None else -1 for r in got) == ids


def test_mixing(spark):
    rows = [(k, "w " * (1 + k % 7), "en", ["a", "b", None][k % 3]) for k in range(300)] + [(None, "x y z", "en", "b"), (5, "same id other text", "en", "a"), (900, None, "en", "a")]
    got = P.mixing_stage(spark, table(spark, rows), "").collect()
    counts = Counter((r.doc_id, r.text) for r in got)
    assert set(counts) <= {(d, t) for d, t, *_ in rows} and max(counts.values()) <= 3 and (900, None) not in counts
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    assert abs(sum(len(r.text.split()) for r in got) - total) <= 3 * 7


def test_packing(spark):
    got = P.packing_stage(spark, table(spark, ROWS), "").collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) >= len(ROWS)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_empty(spark, name):
    assert dict(P.STAGES)[name](spark, table(spark, []), "").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[:-1]])
def test_clashing_columns(spark, name):
    """Columns that are called as inner ones come through whole, and change no decision."""
    from pyspark.sql import functions as F

    names = ["_sha", "_sha2", "_key", "_copies", "_copy", "_nth", "_id", "key", "row", "nth", "sha", "id", "tie", "copies", "kept_id", "language", "own", "fits", "z", "c0", "a b`c"]
    odd = table(spark, ROWS, clash=False).select("doc_id", "text", "lang", "source", *[F.lit(f"is {c}").alias(c) for c in names])
    got = dict(P.STAGES)[name](spark, odd, "")
    plain = dict(P.STAGES)[name](spark, table(spark, ROWS, clash=False), "")
    assert got.columns == odd.columns
    rows = got.collect()
    assert all(r[k + 4] == f"is {c}" for r in rows for k, c in enumerate(names))
    assert Counter((r[0], r[1]) for r in rows) == Counter((r.doc_id, r.text) for r in plain.collect())


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_null_ids(spark, name):
    """Documents without any id are told apart by their texts."""
    rows = [(None, t, lang or "en", s) for _, t, lang, s in texts(40)]
    got = dict(P.STAGES)[name](spark, table(spark, rows), "")
    assert 0 < got.count() and all(r.doc_id is None for r in got.select("doc_id").collect())
