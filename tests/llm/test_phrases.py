import random
import re
from collections import Counter, defaultdict

import pytest

from lectern.llm.phrases import collocations, count_phrases, phrase_counts, word_blocks
from lectern.llm.work import stored
from tests.llm.helpers import frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def named(lang):
    return "und" if lang is None else lang


def counted(rows):
    """Counts of all phrases of 1 to 4 words by language, and numbers of words."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[named(lang)] += len(words)
            for size in (1, 2, 3, 4):
                for i in range(len(words) - size + 1):
                    f[named(lang)][tuple(words[i : i + size])] += 1
    return f, n


def brute(rows, least, top, within):
    f, n = counted(rows)
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            held = any(len(q) > len(p) and 100 * b >= within * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items())
            if not held:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(n=150, seed=4):
    r = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "été", "ñandú", "a", "a", "x\x1cy", "😀", "don't", " "]
    rows = []
    for k in range(n):
        t = ""
        for _ in range(r.randint(0, 60)):
            t += r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " \r "])
            if r.random() < 0.1:
                t += "new York City hall "
        rows.append((k, t, r.choice(["en", "en", "en", "fr", None, ""]), "s"))
    return [*rows, (n, None, "en", "s"), (n + 1, "", None, None), (n + 2, " ,.\n", "de", "s"), (n + 3, "a " * 3000 + "the of " * 2000, "en", "s"), (None, "new york city hall", "fr", "s"), rows[3], rows[3]]


@pytest.mark.parametrize("least,top,within", [(5, 2000, 80), (3, 4, 50), (400, 10, 80)])
def test_collocations(spark, least, top, within):
    rows = texts()
    got = sorted(tuple(r) for r in collocations(frame(spark, rows).repartition(5), least, top, within).collect())
    assert got == brute(rows, least, top, within)
    assert least == 400 or len(got) > 5


def test_sketch_in_segments(spark):
    """Small cells collide, segments are many: counts stay exact."""
    rows = texts()
    blocks = stored(word_blocks(frame(spark, rows).repartition(3)), "b")
    f, _ = counted(rows)
    want = {(lang, " ".join(p), a) for lang, c in f.items() for p, a in c.items() if len(p) > 1 and a >= 4}
    for bits in (3, 8, 22):
        assert {tuple(r) for r in phrase_counts(blocks, 4, bits).collect()} == want


def test_overlapping_matches():
    assert count_phrases(["a a", "a a a", "b a"], "\n a a a a \n b a b \n a ").tolist() == [3, 2, 1]
    assert count_phrases([], " a ").tolist() == []


def test_no_rows(spark):
    assert collocations(frame(spark, [(1, "a b", "en", "s")]).limit(0)).count() == 0
    assert collocations(frame(spark, [(1, None, None, None), (2, "", "en", "s")]), 1).count() == 0
    assert [tuple(r) for r in collocations(frame(spark, [(1, "A a", None, None)]), 1).collect()] == [("und", 1, "a a", 1, 2, 2, 2, 500000)]
