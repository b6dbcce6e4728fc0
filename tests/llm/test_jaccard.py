import random
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pytest

from lectern.llm import jaccard as J
from tests.llm.helpers import frame, texts
from tests.llm.test_dedup import A, brute_components


def brute_sets(rows):
    out = []
    for r in rows:
        w = [x.translate(A) for x in (r[1] or "").split()]
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def near_rows(large=50):
    """Random texts, copies with few and many changed words, a group of copies of one text, and a line that most texts share."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    rows = []
    line = [word() for _ in range(9)]
    for k in range(120):
        w = [word() for _ in range(r.choice([3, 6, 40, 90]))]
        if k % 3 and len(w) > 6:
            w[4:4] = line
        rows.append(w)
        if k % 4 == 0:
            copy = list(w)
            for _ in range(r.randint(1, 3)):
                copy[r.randrange(len(copy))] = word()
            rows.append(copy + [word()] * r.randint(0, 1))
    base = [word() for _ in range(100)]
    for k in range(large):
        copy = list(base)
        copy[r.randrange(100)] = f"only{k}"
        copy[r.randrange(100)] = f"own{k}"
        rows.append(copy)
    return [(k, " ".join(w).upper() if k % 9 == 0 else " ".join(w), "en", "a") for k, w in enumerate(rows)]


@pytest.mark.parametrize("sampled", [True, False])
def test_all_pairs(spark, monkeypatch, sampled):
    if not sampled:  # no shingle is known as common: more work, the same links
        monkeypatch.setattr(J, "COMMON_MOST", 0)
    rows = near_rows() + [(1000 + k, *r[1:]) for k, r in enumerate(texts()) if r[0] is not None] + [(7, near_rows()[7][1], "en", "a")]
    sets = brute_sets(rows)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    least = {}
    comp = brute_components(range(len(rows)), links)
    for i, c in comp.items():
        least[c] = min(rows[i][0], least.get(c, rows[i][0]))
    got = J.jaccard_components(frame(spark, rows)).collect()
    assert Counter((x.doc_id, x.component_id) for x in got) == Counter((rows[i][0], least[c]) for i, c in comp.items())
    assert J.jaccard_components(frame(spark, [])).count() == 0


def test_stage_drops_near_copies(spark):
    """Copies whose fingerprints of three words lie more than two bits apart go too."""
    from lectern.llm.simhash import fingerprint

    r = random.Random(5)
    one = [f"w{r.randrange(10**6)}" for _ in range(120)]
    two, far = list(one), list(one)
    two[30] = two[90] = "changed"
    for k in range(5, 120, 12):
        far[k] = "changed"
    rows = [(k, " ".join(w), "en", "a") for k, w in enumerate((one, two, far))]
    assert (fingerprint(rows[0][1]) ^ fingerprint(rows[1][1])).bit_count() > 2
    assert sorted(x.doc_id for x in P.near_stage(spark, frame(spark, rows, clash=False), "").collect()) == [0, 2]


def test_bounds():
    """Prefixes of similar sets meet in whatever order, and parities rule no similar pair out."""
    r = np.random.default_rng(2)
    for n in (1, 2, 4, 5, 6, 33, 300):
        for _ in range(40):
            own = np.unique(r.integers(-(2**63), 2**63 - 1, n))
            gone = r.integers(0, n // 5 + 1)
            other = np.unique(np.concatenate([own[r.permutation(len(own))[gone:]], r.integers(-(2**63), 2**63 - 1, r.integers(0, n // 8 + 1))]))
            if not J.similar(len(np.intersect1d(own, other)), len(own), len(other)):
                continue
            common = np.unique(r.choice(np.union1d(own, other), n))
            rank = r.integers(3, 9, len(common))
            assert len(np.intersect1d(J.prefix(own, common, rank), J.prefix(other, common, rank)))
            assert not J.surely_apart(J.parity(own), J.parity(other), len(own), len(other))
    assert J.surely_apart(J.parity(np.arange(0, 200)), J.parity(np.arange(1000, 1200)), 200, 200)
