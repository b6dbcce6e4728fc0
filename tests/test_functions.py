import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.functions import scalars as X
from lectern.functions import text as T
from lectern.operators import mapping, markup, narration, store, taste, timing
from lectern.operators import voices as voice_choice
from lectern.plans.asof import asof_join
from lectern.plans.corpus import paragraphs, sentences
from lectern.plans.intervals import interval_join
from lectern.plans.ranks import global_places, upper_median_by_counts


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mr. Smith went to St. Ives. He met J. Doe.", ["Mr. Smith went to St. Ives.", "He met J. Doe."]),
        ("“Stop!” he said. “Why?” She left.", ["“Stop!”", "he said.", "“Why?”", "She left."]),
        ("It cost 3.50 today. 7 came.", ["It cost 3.50 today.", "7 came."]),
        ("Well… maybe not. ok? Yes!? no", ["Well… maybe not. ok?", "Yes!? no"]),
        ("Fin. Été vient.", ["Fin. Été vient."]),
        ("one", ["one"]),
    ],
)
def test_sentences(spark, text, want):
    got = one(spark, T.sentence_pieces(F.col("t")), t=text)
    expected = [w.strip() for w in want]
    if text.startswith("“Stop"):
        assert [g.strip() for g in got][-2:] == expected[-2:]
    else:
        assert [g.strip() for g in got] == expected
    assert "".join(got) == text


def test_sentence_invariant(spark):
    r = random.Random(5)
    alphabet = ["Mr", "A", "x", " ", ". ", "! ", "…", "?", '"', "”", "3", "\t", "É", "vs", ") "]
    rows = [(k, "".join(r.choice(alphabet) for _ in range(r.randint(1, 30)))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    paras = {(x.doc_id, x.c, x.p): x.text for x in paragraphs(docs).collect()}
    for s in sentences(paragraphs(docs)).collect():
        assert paras[s.doc_id, s.c, s.p][s.start :].startswith(s.text)
    words = sentences(paragraphs(docs)).groupBy("doc_id", "c", "p").agg(F.sum("n_words").alias("n")).collect()
    assert {(w.doc_id, w.c, w.p): w.n for w in words} == {k: len(re.findall(r"\S+", t)) for k, t in paras.items()}


def test_many_sentences(spark):
    """A line of 100,000 sentences is as quick a sentence as a short one."""
    import time

    line = "".join(f"Word number {k} is here. " for k in range(100_000))
    docs = spark.createDataFrame([(1, line), (2, "One. Two."), (3, ""), (4, None)], "doc_id long, text string")
    begin = time.time()
    got = sentences(paragraphs(docs)).agg(F.count("*").alias("n"), F.max("start").alias("at"), F.max("word_start").alias("w")).first()
    assert (got.n, got.at, got.w) == (100_002, len(line) - len("Word number 99999 is here. "), 499_995) and time.time() - begin < 60
    packed = narration.units(paragraphs(docs), 320).filter("doc_id = 1").agg(F.max("s_end").alias("e"), F.max("chars").alias("c")).first()
    assert packed.e == 100_000 and packed.c <= 320


def test_groups_and_cues(spark):
    long = "And " * 60 + "stop, " + "more " * 60 + "end."
    docs = spark.createDataFrame([(1, f"Short one. Tiny. {long} Then a last one.")], "doc_id long, text string")
    got = [tuple(r)[3:] for r in narration.sentence_groups(paragraphs(docs)).orderBy("grp", "part").collect()]
    assert got[0] == (0, 0, 2, 0, 16) and [g[3] for g in got if g[0] == 1] == [0, 1] and all(g[4] <= 380 for g in got)
    cues = spark.createDataFrame([(c, k, t) for c in (1, 2, None) for k, t in enumerate(["a  b", "a b", "x" * 460, "end.", " ", "more"])], "conv int, turn int, text string").repartition(3)
    found = [tuple(r) for r in narration.coalesce_cues(cues, "conv", "turn").orderBy("conv", "para").collect()]
    assert found == [(c, k, t) for c in (None, 1, 2) for k, t in enumerate([f"a b {'x' * 460} end.", "more"])]
    seen = spark.createDataFrame([(1, k, 100.0 + k, 6.0) for k in range(9)] + [(1, 99, 1.0, 9.0), (2, 1, 50.0, 5.0)], "u int, k int, chars double, seconds double")
    want = 15.5
    for k in range(9):
        want = want * 0.7 + (100.0 + k) / 6 * 0.3
    rate = {r.u: r.cps for r in narration.learned_rate(seen, "u", ["k"]).collect()}
    assert abs(rate[1] - want) < 1e-9 and abs(rate[2] - (15.5 * 0.7 + 3.0)) < 1e-9


def test_normalize(spark):
    assert one(spark, T.normalize(F.col("t")), t="  L’été — «Œuvre» ß well-known ROCK'N'ROLL  ") == "lete oeuvre ss wellknown rocknroll"
    assert one(spark, T.normalize(F.lit(None).cast("string"))) == ""


def test_syllables(spark):
    for word, n in (("the", 1), ("banana", 3), ("queue", 2), ("walked", 1), ("yes", 1), ("beautiful", 4), ("123", 0), ("make", 1)):
        assert one(spark, T.syllables(F.col("w")), w=word) == n, word


def test_rounding_and_hash(spark):
    assert one(spark, T.js_round(F.lit(-2.5))) == -2 and one(spark, T.js_round(F.lit(2.345), 2)) == 2.35
    h = 2166136261
    for c in "Alice":
        h = (h ^ ord(c)) * 16777619 % 2**32
    assert one(spark, T.fnv1a(F.col("t")), t="Alice") == h and one(spark, T.fnv1a(F.col("t")), t="") == 2166136261


def test_scalars(spark):
    assert one(spark, X.clean_author(F.col("a")), a="Austen, Jane, 1775-1817") == "Jane Austen"
    assert one(spark, X.clean_subjects(F.array("a")), a="Love stories -- Fiction; In library; sea (north, south), whales, 1999 things") == ["Love Stories", "Sea (North, South)", "Whales"]
    assert one(spark, X.file_title(F.col("n")), n="my_book-two.fb2.zip") == "my book two"
    assert [one(spark, X.fmt_compact(F.lit(n))) for n in (999.4, 1000.0, 12345.0, 2500000.0)] == ["999", "1k", "12k", "2.5M"]
    assert one(spark, X.resolve_path(F.col("b"), F.col("h")), b="OEBPS/text/", h="../images/a%20b.png#x") == "OEBPS/images/a b.png"
    assert one(spark, X.format_duration(F.lit(3725.0))) == "1h 2m" and one(spark, X.format_minutes(F.lit(120.0))) == "2h"
    assert one(spark, X.escape_xml(F.col("t")), t="<a & 'b'>") == "&lt;a &amp; &#39;b&#39;&gt;"


def test_asof(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (2, 9), (1, 10)], "k int, t int")
    right = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (1, 7, "c")], "k int, s int, v string")
    assert {(r.k, r.t): r.v for r in asof_join(left, right, ["k"], "t", "s").collect()} == {(1, 5): "b", (1, 0): None, (2, 9): None, (1, 10): "c"}
    assert {(r.k, r.t): r.v for r in asof_join(left, right, ["k"], "t", "s", forward=True).collect()} == {(1, 5): "b", (1, 0): "a", (2, 9): None, (1, 10): None}


def test_ranks(spark):
    rows = [("a", x) for x in (5, 1, 1, 9)] + [("b", 3)]
    got = upper_median_by_counts(spark.createDataFrame(rows, "g string, v int"), "g", "v").collect()
    assert {r.g: r["median"] for r in got} == {"a": 5, "b": 3}
    places = global_places(spark.range(1000).selectExpr("id * 7 % 1000 as v"), ["v"]).collect()
    assert all(r.place == r.v + 1 for r in places)


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize(("rows", "wide"), [(2_000_000, False), (200_000, True)])
def test_places_at_scale(spark, adaptive, rows, wide):
    """Places are 1..n in order, whatever adaptive execution makes of the exchanges and however wide rows are."""
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        df = spark.range(rows).select((F.col("id") * 7919 % rows).alias("v"), *([F.repeat(F.lit("x"), 500).alias("text")] if wide else []))
        got = global_places(df, ["v"])
        assert got.agg(F.count("*"), F.sum(F.abs(F.col("place") - F.col("v") - 1))).first()[:] == (rows, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])


def test_mapping(spark):
    books = spark.createDataFrame([("none", 1000, None), ("pages", 1000, 10), ("one", 5000, None), ("two", 5000, None)], "book_id string, total_words int, total_pages int")
    points = mapping.latest_points(spark.createDataFrame([("one", 10, 2800, 1), ("two", 10, 1000, 1), ("two", 20, 9999, 1), ("two", 20, 2000, 2), ("two", 30, 4000, 1)], "book_id string, page int, g int, at int"))
    asked = spark.createDataFrame([(b, p) for b in ("none", "pages", "one", "two") for p in (1, 10, 15, 20, 25, 35)], "book_id string, page int")
    got = {(r.book_id, r.page): r.g for r in mapping.page_to_global(asked, points, books).collect()}
    assert got["none", 1] is None and got["pages", 10] == 900 and got["one", 15] == 2800 + 5 * 280
    assert [got["two", p] for p in (1, 10, 15, 20, 25, 35)] == [0, 1000, 1500, 2000, 3000, 4750]
    back = {(r.book_id, r.g): r.page for r in mapping.global_to_page(spark.createDataFrame([("two", 1000), ("two", 2000), ("two", 4000), ("two", 3000)], "book_id string, g int"), points, books).collect()}
    assert back == {("two", 1000): 10, ("two", 2000): 20, ("two", 4000): 30, ("two", 3000): 25}


def test_chapters(spark):
    rows = [(1, 0, False, "front"), (1, 1, True, "PART"), (1, 2, True, "ONE"), (1, 3, False, "a b"), (1, 4, True, "TWO"), (1, 5, False, "c"), (1, 6, True, "END"), (2, 0, True, "X")]
    got = [tuple(r) for r in markup.chapters(spark.createDataFrame(rows, "d int, i int, heading boolean, text string"), "d").orderBy("d", "idx").collect()]
    assert got == [(1, 0, "Section 1", 1, 1), (1, 1, "PART · ONE", 1, 2), (1, 2, "TWO", 1, 1)]


def test_heading_runs(spark):
    kinds = ["heading"] * 4 + ["para", "heading", "heading"]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(kinds)], "doc_id int, i int, kind string")
    assert [r.kind for r in markup.heading_runs(rows).orderBy("i").collect()] == ["toc"] * 4 + ["para", "heading", "heading"]


def test_normal_form(spark):
    """Against the standard library's decomposition, over every character that has one."""

    def plain(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not "\u0300" <= c <= "\u036f").lower()
        t = t.translate(str.maketrans("‘’‚‛`“”„‟«»‐‑‒–—―", "'" * 5 + '"' * 6 + "-" * 6)).replace("æ", "ae").replace("œ", "oe").replace("ß", "ss")
        return re.sub(r"\s+", " ", re.sub(r"['-]", "", re.sub(r"[^a-z0-9 \t\n\r\x0b\x0c'-]", " ", t))).strip()

    marked = [chr(c) for c in range(0x80, 0x110000) if unicodedata.decomposition(chr(c)) and not 0xD800 <= c < 0xE000]
    rows = [f"a{''.join(f'x{c}y ' for c in marked[k : k + 40])}" for k in range(0, len(marked), 40)] + ["ő ş č ﬁn ﬄ Ｆｕｌｌ １２ ½ ⑩ e\u0301 Ǽ ẞ İ K 𝐁old", "", "plain – it’s"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").select("k", T.normalize(F.col("t")).alias("n")).collect()
    for r in got:
        assert r.n == plain(rows[r.k]), (rows[r.k], r.n)


def test_voices(spark):
    voices = spark.createDataFrame([("v1", 1, "Ann Lee", ["Warm", "deep"], "cloned"), ("v2", 2, "Bob", ["deep"], "premade"), ("v3", 3, "anna", None, "premade"), ("v4", 4, "Deep Warm", [], "premade")], "voice string, ord int, name string, labels array<string>, category string")
    personas = [("own", "x9", ["Ann"], ["deep"]), ("hint", None, ["zed", "ANN"], ["deep"]), ("order", None, ["bob", "ann"], []), ("one", None, [], ["deep"]), ("two", None, [], ["deep", "warm"]), ("none", None, [], ["loud"]), ("nothing", None, None, None)]
    table = spark.createDataFrame(personas, "persona string, override string, hints array<string>, labels array<string>")
    got = {r.persona: (r.voice, r.why) for r in voice_choice.resolve(table, voices).collect()}
    assert got == {"own": ("x9", "choice"), "hint": ("v1", "hint"), "order": ("v2", "hint"), "one": ("v2", "labels"), "two": ("v4", "labels"), "none": ("v2", "labels"), "nothing": ("v2", "labels")}
    assert {r.voice for r in voice_choice.resolve(table.filter("persona = 'one'"), voices.limit(0)).collect()} == {None}


def test_chunks(spark):
    text = "alpha beta, gamma delta; epsilon zeta eta theta"
    got = one(spark, narration.chunk_text(F.col("t"), 20), t=text)
    assert "".join(got) == text and all(len(x) <= 20 for x in got)


def test_segments(spark):
    words = spark.createDataFrame([(1, k // 2, k % 2, "w" * (k + 1)) for k in range(8)] + [(2, 0, 0, "x")], "u int, s int, w int, word string")
    seg = spark.createDataFrame([(1, 0, 1, 0.0, 1.0), (1, 1, 2, 1.0, 3.0), (1, 3, 3, 9.0, 9.0), (1, 3, 4, 5.0, 6.0), (1, 3, 9, 4.0, 8.0), (1, None, 4, 0.0, 1.0)], "u int, s_start int, s_end int, a double, b double")
    got = timing.times_from_segments(words, seg, ["u"]).orderBy("u", "s", "w").collect()
    assert got[0].start == 0 and got[1].end == 1 and got[3].end == 3 and got[5].start == got[3].start
    assert got[6].start == 4 or got[6].start == 5
    assert (got[8].start, got[8].end) == (0, 0)


def test_interval_join(spark):
    r = random.Random(2)
    points = [(r.choice("ab"), r.randint(-40, 90)) for _ in range(300)] + [("a", None)]
    spans = [(r.choice("ab"), lo, lo + r.choice([0, -3, 1, 5, 70]), k) for k, lo in enumerate(r.randint(-50, 60) for _ in range(80))] + [("b", 0, None, 99), ("b", None, 5, 98)]
    got = interval_join(spark.createDataFrame(points, "k string, x int"), spark.createDataFrame(spans, "k string, lo int, hi int, n int"), ["k"], "x", "lo", "hi", 16)
    want = Counter((k, x, lo, hi, n) for k, x in points for k2, lo, hi, n in spans if k == k2 and None not in (x, lo, hi) and lo <= x < hi)
    assert Counter(tuple(t) for t in got.collect()) == want and want


def test_fallbacks(spark):
    words = spark.createDataFrame([(u, 0, 0, 0, 2, "ab") for u in range(5)] + [(u, 0, 1, 3, 3, "cd.") for u in range(5)], "u int, s int, w int, char int, len int, word string")
    units = spark.createDataFrame([(0, 6, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5], [0.1, 0.2, 0.0, 0.4, 0.5, None], 6, 9.0), (1, 6, None, None, None, 9.0), (2, 6, [], None, None, 9.0), (3, 6, None, None, None, 0.0), (4, 600, None, None, None, None)], "u int, chars int, starts array<double>, ends array<double>, n int, duration double")
    marks = spark.createDataFrame([(1, 0, 2.0, 0.0)], "u int, s int, t double, duration double")
    got = {(r.u, r.w): (round(r.start, 6), round(r.end, 6), r.how) for r in timing.unit_times(words, units, timing.segments_from_marks(marks, ["u"]), ["u"]).collect()}
    assert got[0, 0] == (0.0, 0.2, "characters") and got[0, 1] == (0.3, 0.5, "characters")
    assert got[1, 0][0] == 2.0 and got[1, 1][1:] == (5.0, "segments")
    assert got[2, 1][1:] == (9.0, "duration") and got[3, 1][1:] == (1.0, "length") and got[4, 1][1:] == (40.0, "length")


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = store.upsert(old, new, ["k"])
    want = {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in store.upsert(once, new, ["k"]).collect()}
    settings = spark.createDataFrame([("theme", "x"), ("apiKey", "s"), ("speechKey", "s"), ("big", "y" * 5000)], "key string, value string")
    rows = store.backup({"books": old}, settings)
    assert not rows.filter("json like '%Key%'").count() and store.settings_mirror(settings).count() == 1
    assert store.restore(rows, {"books": old.schema})["books"].count() == 2
    with pytest.raises(ValueError):
        store.restore(rows.withColumn("mark", F.lit("?")), {"books": old.schema})


def test_labels(spark):
    assert one(spark, taste.length_band(F.lit(59_999))) == "Short novel"
    assert one(spark, taste.archetype(F.lit("sea history"), F.lit(0.7), F.lit(0), F.lit(0), F.lit(50))) == "Deep-diver, mostly by ear"


def test_syllables_of_whole_texts(spark):
    """Marks of a text say for each word what syllables() says, and readability takes no word at a time."""
    import random

    r = random.Random(7)
    some = ["".join(r.choice("aeiouybcdlstxyé'1E-") for _ in range(r.randint(1, 9))) + r.choice(["", "es", "ed", "e", "le", "s"]) for _ in range(3000)]
    rows = [(k, r.choice([" ", "\u00a0", "\u3000 ", "\n"]).join(some[k : k + r.randint(1, 12)])) for k in range(len(some))]
    df = spark.createDataFrame(rows, "k int, text string")
    own = F.transform(T.words(F.col("text")), T.syllables)
    marks = T.syllable_marks(F.col("text"))
    got = df.select("text", F.aggregate(own, F.lit(0), lambda a, x: a + x), F.regexp_count(marks, F.lit(T.SOUNDS)), F.size(F.filter(own, lambda x: x >= 3)), F.regexp_count(marks, F.lit(T.LONG)))
    assert [tuple(x) for x in got.collect() if x[1] != x[2] or x[3] != x[4]] == []
