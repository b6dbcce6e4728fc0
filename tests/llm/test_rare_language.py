from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

from lectern.llm.language_id import UNKNOWN, fit, identify
from tests.llm.helpers import frame
from tests.llm.test_corpus import language_rows

RARE = [(10_000, "Ελληνικά κείμενα για όλους τους ανθρώπους", "el", "a"), (10_001, "русский текст для всех людей на земле", "ru", "b")]


def test_rare_labels_are_fitted(spark):
    """A label of one row is in the model of a table far larger than the sample, and the sample of the others keeps its bound."""
    table = frame(spark, language_rows(600) + RARE, clash=False)
    model = fit(table, most_rows=10)
    assert model.languages == ["de", "el", "en", "fr", "ru"]
    found = identify(table, model, F.col("text")).filter("doc_id >= 10000").collect()
    assert {x.doc_id: x.language for x in found} == {10_000: "el", 10_001: "ru"}


def test_repeated_rows_leave_room(spark):
    """Many equal rows of one label neither push others out nor, when their hash is high, lose their own label."""
    rows = language_rows(60) + RARE[:1] + RARE[1:] * 500
    assert fit(frame(spark, rows, clash=False), most_rows=5).languages == ["de", "el", "en", "fr", "ru"]


def test_counts_are_of_all_rows(spark):
    """Up to the bound a label's rows all count, repeated ones as often as they come."""
    rows = language_rows(40)
    one, two = fit(frame(spark, rows + rows[:7], clash=False)), fit(frame(spark, [(k, *r[1:]) for k, r in enumerate(rows + rows[:7])], clash=False))
    assert one.languages == two.languages and (one.log_p == two.log_p).all()


def test_stage_keeps_rare_languages(spark, monkeypatch):
    import lectern.llm.language_id as m

    monkeypatch.setattr(m.fit, "__defaults__", ("text", "lang", 10))
    rows = language_rows(600) + RARE
    kept = Counter(x.doc_id for x in P.language_stage(spark, frame(spark, rows, clash=False), "").collect())
    assert kept[10_000] == kept[10_001] == 1
    assert UNKNOWN not in fit(frame(spark, rows, clash=False)).languages


def test_every_labelled_row_counts(spark):
    """Counts are of all rows, however many a label has: a trigram that few of 6000 rows hold is counted in each of them, and parts of counts meet."""
    import numpy as np
    import pyarrow as pa

    from lectern.llm.language_id import GRAMS, NOISE, grams

    rows = [(k, "aaaa", "a", "s") for k in range(6000)] + [(k, f"bbb {'x' * (k % 5)}", "b", "s") for k in range(6000, 6010)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7))
    for k, lang in enumerate(("a", "b")):
        counts = np.bincount(grams(pa.array([r[1] for r in rows if r[2] == lang]))[0], minlength=GRAMS)
        want = np.log((1 - NOISE) * (counts + 0.5) / (counts.sum() + 0.5 * GRAMS) + NOISE / GRAMS).astype(np.float32)
        assert model.languages[k] == lang and (model.log_p[k] == want).all()
