import random

from pyspark.sql import functions as F

from lectern.functions.scalars import fixed1
from lectern.operators import catalog, taste, voices


def test_kinds_of_voices(spark):
    """Voices that score alike meet personas once, however many they are."""
    held = spark.range(1000).select(F.col("id").alias("voice"), (1000 - F.col("id")).alias("ord"), F.lit(0.2).alias("extra"), F.array(F.lit("a"), F.concat(F.lit("n"), F.col("id") % 2)).alias("held"))
    assert sorted((r.voice, tuple(r.held)) for r in voices.kinds(held).collect()) == [(998, ("a", "n0")), (999, ("a", "n1"))]


def test_labels_by_brute_force(spark):
    r = random.Random(4)
    speakers = [(k, 100 - k, f"Voice {k}", r.choices("abcde", k=r.randint(0, 3)), r.choice(["premade", "cloned"])) for k in range(60)]
    personas = [(k, r.choices([*"abcde", "voice 7", "zz"], k=r.randint(0, 4))) for k in range(80)] + [(99, None)]
    got = voices.by_labels(spark.createDataFrame(personas, "persona int, labels array<string>"), spark.createDataFrame(speakers, "voice int, ord int, name string, labels array<string>, category string"))

    def want(labels):
        scores = [(-(sum(x in f"{' '.join(own)} {name.lower()}" for x in labels or [])), kind != "premade", order, voice) for voice, order, name, own, kind in speakers]
        return min(scores)[3]

    assert {x.persona: x.voice for x in got.collect()} == {k: want(labels) for k, labels in personas}


def test_fixed1(spark):
    """As C prints them: by the number that is stored, ties to even."""
    r = random.Random(1)
    numbers = [1.15, 1.25, 1.35, 1.75, 2.45, 9.95, 9.96, 0.05, 0.15, 0.25, 0.35, -1.25, -1.15, 0.0, 1e15 + 0.25, 123456.75] + [r.randint(1000, 99999) / 1000 for _ in range(500)] + [r.randint(20, 9999) / 20 for _ in range(300)] + [r.random() for _ in range(200)]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", fixed1(F.col("x")).alias("t")).collect()
    assert {x.x: x.t for x in got} == {x: f"{x:.1f}".removesuffix(".0") for x in numbers}


def test_seeds_of_equal_weight(spark):
    """Of subjects with one weight the first by ord are seeds, not the first by name."""
    named = spark.createDataFrame([(name, 1.0, k) for k, name in enumerate("zeta eta theta iota alpha".split())], "name string, w double, ord int")
    shelf = spark.createDataFrame([(k, f"book {k}", "x", [name], 3.6, 100, False) for k, name in enumerate("zeta eta theta iota alpha".split())], "id int, title string, author string, subjects array<string>, rating double, pages int, full_text boolean")
    none = shelf.filter("id < 0")
    got = catalog.recommend(shelf, taste.taste(named, 8, True), spark.createDataFrame([], "key string, name string"), none, none)
    assert sorted(x.id for x in got.collect()) == [0, 1, 2, 3]
