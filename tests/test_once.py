import os

import pytest

from lectern import registry
from lectern.operators import matching
from lectern.plans.corpus import paragraphs

DATA = "/root/testdata/sf0.001"
registry.load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shingles_stay_in_their_book(spark):
    docs = spark.createDataFrame([(1, "a b c d e\na b c d"), (2, "a b c d")], "doc_id long, text string")
    got = matching.postings(paragraphs(docs))
    exchanges = [x for x in plan(got).split("\n") if "Exchange hashpartitioning" in x]
    assert len(exchanges) == 1 and "key" not in exchanges[0].split("hashpartitioning(")[1].split(")")[0]
    assert sorted((r.doc_id, r.key, r.p, r.n) for r in got.collect()) == [(1, "a b c d", 0, 2), (1, "a b c d", 1, 2), (1, "b c d e", 0, 1), (2, "a b c d", 0, 1)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name, work", [("loc_to_global", "split("), ("duplicate_docs", "sha2(")])
def test_texts_are_taken_apart_once(spark, name, work):
    assert work not in plan(registry.QUERIES[name](spark, DATA))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["page_body", "page_paragraphs", "page_chapters"])
def test_pages_are_laid_out_once(spark, name):
    """What is left to do after lines or blocks are kept makes no items again."""
    assert "Running head" not in plan(registry.QUERIES[name](spark, DATA))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_sentences_are_found_once_to_clamp(spark):
    assert "messrs" not in plan(registry.QUERIES["clamp_locators"](spark, DATA))


def test_normal_forms_look_marks_up_in_no_table(spark):
    from pyspark.sql import functions as F

    from lectern.functions.text import DASHES, QUOTES, normalize

    rows = spark.createDataFrame([("it`s a well—known ‘Straße’ - “Ænd” «x» y",)], "text string").select(normalize(F.col("text")).alias("n"))
    assert QUOTES + DASHES not in plan(rows) and rows.first().n == "its a wellknown strasse aend x y"
