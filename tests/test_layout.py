"""Fixed pages, step by step."""

from pyspark.sql import functions as F

from lectern.operators import layout as L

ITEMS = "doc_id string, page int, str string, x double, y double, h double, w double"
LINES = "doc_id string, page int, line int, text string, x double, x_end double, y double, h double"
BLOCKS = "doc_id string, page int, block int, text string, heading boolean"
ORDERED = "doc_id string, ord int, page int, text string, heading boolean"
OUTLINE = "doc_id string, items array<struct<title:string,page:int,items:array<struct<title:string,page:int>>>>"


def test_items(spark):
    items = [("d", 1, "First", 50.0, 700.0, 10.0, 20.0), ("line", 75.0, 699.0, 10.0, 20.0), ("x²", 95.5, 698.9, 12.0, 5.0), ("  ", 10.0, 690.0, 9.0, 1.0), ("below ", 50.0, 688.0, 10.0, 30.0), ("all", 90.0, 688.0, 10.0, 20.0), ("　", 1.0, 1.0, 1.0, 1.0)]
    items = [items[0], *[("d", 1, *x) for x in items[1:]]]
    got = L.items_to_lines(spark.createDataFrame(items, ITEMS)).orderBy("line").collect()
    assert [(r.text, r.x, r.x_end, r.y, r.h) for r in got] == [("First linex²", 50.0, 100.5, 700.0, 12.0), ("below all", 50.0, 110.0, 688.0, 10.0)]


def test_furniture(spark):
    def page(p):
        return ["RUNNING HEAD", f"own {'abcd'[p]}", "b", "middle 12", f"other {'wxyz'[p]}", ["iv", "12", "x c", "XIV"][p]]

    lines = [("d", p, k, t, 0.0, 1.0, 0.0, 1.0) for p in range(4) for k, t in enumerate(page(p))] + [("e", p, 0, "Head", 0.0, 1.0, 0.0, 1.0) for p in range(2)]
    left = L.strip_furniture(spark.createDataFrame(lines, LINES))
    assert [r.text for r in left.filter("doc_id = 'd'").orderBy("page", "line").collect()] == [t for p in range(4) for t in page(p)[1:5]]
    assert left.filter("doc_id = 'e'").count() == 2


def test_paragraphs(spark):
    rows = [("Chapter One", 50, 14), ("It goes on, and", 50, 10), ("never sto-", 50, 10), ("ps. Short.", 50, 10), ("After a short line it is new", 50, 10), ("A heading that ends in a colon:", 50, 14), ("indented twice over here", 65, 10), ("indented again, the same", 65, 10)]
    lines = [("d", 1, k, t, float(x), float(x + 5 * len(t)), 700.0 - 12 * k, float(h)) for k, (t, x, h) in enumerate(rows)]
    lines += [("d", 1, 8, "far below", 50.0, 95.0, 500.0, 10.0), ("d", 1, 9, "This is a very high line but it is quite a sentence.", 50.0, 300.0, 488.0, 14.0)]
    got = [(r.text, r.heading) for r in L.lines_to_paragraphs(spark.createDataFrame(lines, LINES)).orderBy("block").collect()]
    assert got == [
        ("Chapter One", True), ("It goes on, and never stops. Short.", False), ("After a short line it is new A heading that ends in a colon:", False),
        ("indented twice over here indented again, the same", False), ("far below This is a very high line but it is quite a sentence.", False),
    ]


def test_merge(spark):
    blocks = [("d", 1, 1, "goes on", False), ("d", 2, 1, "and on", False), ("d", 3, 1, "and hy-", False), ("d", 4, 1, "phen", False), ("d", 4, 2, "same page", False), ("d", 6, 1, "not next", False), ("d", 7, 1, "Ends.", False), ("d", 8, 1, "no", False), ("d", 9, 1, "heading", True), ("d", 10, 1, "x", False), ("d", 11, 1, "Capital", False)]
    got = [(r.page, r.text) for r in L.merge_pages(spark.createDataFrame(blocks, BLOCKS)).orderBy("ord").collect()]
    assert got == [(1, "goes on and on"), (3, "and hyphen"), (4, "same page"), (6, "not next"), (7, "Ends."), (8, "no"), (9, "heading"), (10, "x"), (11, "Capital")]


def test_outline(spark):
    items = [("  A  b ", 3, [("A1", 5), ("A2", 3), ("", 7)]), ("No page", None, [("N1", 1), ("N2", 5)]), (None, 9, None), ("Z", 9, [])]
    flat = L.flat_outline(spark.createDataFrame([("d", items), ("e", []), ("f", None)], OUTLINE))
    assert sorted((r.page, r.title) for r in flat.collect()) == [(1, "N1"), (3, "A b"), (5, "A1"), (9, "Z")]


def test_strategies(spark):
    blocks = [("o", 1, 1, "before", False), ("o", 2, 2, "PART", True), ("o", 3, 2, "Part one!", True), ("o", 4, 2, "Inside", True), ("o", 5, 2, "part", True), ("o", 6, 2, "Part One", True), ("o", 7, 3, "text", False), ("o", 8, 9, "Late", True)]
    blocks += [("h", 1, 1, "front", False), ("h", 2, 1, "One", True), ("h", 3, 1, "Sub", True), ("h", 4, 1, "a", False), ("h", 5, 2, "Two", True), ("h", 6, 2, "b", False), ("h", 7, 2, "Empty", True)]
    blocks += [("p", 1, 1, "x", False), ("p", 2, 21, "y", False), ("p", 3, 41, "z", True)] + [("s", 1, 1, "x", False), ("s", 2, 40, "y", False)]
    outline = spark.createDataFrame([("o", 2, "Part One"), ("o", 4, "Nothing"), ("o", 9, "Late"), ("h", 1, "only one")], "doc_id string, page int, title string")
    docs = spark.createDataFrame([("o", 9, ""), ("h", 2, "H"), ("p", 41, "P"), ("s", 40, None), ("none", 3, "N")], "doc_id string, pages int, title string")
    got = L.chapters(spark.createDataFrame(blocks, ORDERED), outline, docs).orderBy("doc_id", "c", "p").collect()
    assert [(r.doc_id, r.strategy, r.c, r.title, r.text) for r in got] == [
        ("h", "headings", 0, "Front matter", "front"), ("h", "headings", 1, "One · Sub", "a"), ("h", "headings", 2, "Two", "b"),
        ("o", "outline", 0, "Front matter", "before"), ("o", "outline", 1, "Part One", "Inside"), ("o", "outline", 1, "Part One", "part"), ("o", "outline", 1, "Part One", "text"),
        ("p", "pages", 0, "Pages 1–20", "x"), ("p", "pages", 1, "Pages 21–40", "y"), ("p", "pages", 2, "Pages 41–41", "z"),
        ("s", "pages", 0, "Full text", "x"), ("s", "pages", 0, "Full text", "y"),
    ]


def test_recognised(spark):
    lines = spark.createDataFrame([("d", 1, 0, "x" * 39, 0.0, 1.0, 1.0, 1.0), ("d", 2, 0, "y" * 40, 0.0, 1.0, 1.0, 1.0)], LINES)
    blocks = L.lines_to_paragraphs(lines)
    seen = spark.createDataFrame([("d", p, 1, f"seen {p}") for p in (1, 2, 3)], "doc_id string, page int, block int, text string")
    assert sorted((r.page, r.text) for r in L.with_recognised(blocks, lines, seen).collect()) == [(1, "seen 1"), (2, "y" * 40), (3, "seen 3")]
    assert L.read_pages(spark.createDataFrame([], ITEMS), spark.createDataFrame([], OUTLINE), spark.createDataFrame([], "doc_id string, pages int, title string")).filter(F.lit(True)).count() == 0
