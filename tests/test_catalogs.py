"""Catalogue answers: fields of one value or several, and what is broken."""

from lectern.sources import catalogs as S

ANSWERS = "source string, answer long, payload string"


def test_shapes(spark):
    answers = [
        ("archive", 1, '{"response":{"docs":[{"identifier":"i1","title":["A","B"],"creator":"X","subject":["a;b","c"],"year":1901,"language":"en"},{"identifier":"i2","creator":["X","Y","Z"],"year":["1875","1900"]},{"title":"no id"},null]}}'),
        ("openlibrary", 2, '{"docs":[{"key":"/w/1","subject":"one","author_name":null},{"key":"/w/2","title":" ","ebook_access":"public","ia":["x"],"language":["eng","fre"]}]}'),
        ("gutenberg", 3, '{"results":[{"id":7,"title":"T","authors":[{"name":"P"},{"name":"Q"}],"subjects":["s"],"bookshelves":["b"]}]}'),
        ("google", 4, '{"items":[{"id":"g","volumeInfo":{"title":"T","subtitle":"U","publishedDate":"1999-01-02"},"accessInfo":{"publicDomain":true,"epub":{}}},{"id":"h"}]}'),
        ("google", 5, "<html>"), ("google", 6, None), ("archive", 7, "  "), ("gutenberg", 8, "{}"), ("elsewhere", 9, "{}"), (None, 10, "{}"), ("openlibrary", 11, '{"docs":'),
    ]
    table = spark.createDataFrame(answers, ANSWERS)
    got = {r.id: r for r in S.records(table).collect()}
    assert set(got) == {"ia:i1", "ia:i2", "ol:/w/1", "ol:/w/2", "pg:7", "gb:g", "gb:h"}
    assert (got["ia:i1"].title, got["ia:i1"].author, got["ia:i1"].year, got["ia:i1"].subjects, got["ia:i1"].languages) == ("A", "X", 1901, ["a", "b", "c"], ["en"])
    assert (got["ia:i2"].title, got["ia:i2"].author, got["ia:i2"].year, got["ia:i2"].downloads) == ("i2", "X, Y", 1875, 0)
    assert (got["ol:/w/1"].title, got["ol:/w/1"].subjects, got["ol:/w/1"].full_text) == ("Untitled", ["one"], False)
    assert (got["ol:/w/2"].title, got["ol:/w/2"].languages, got["ol:/w/2"].full_text) == ("Untitled", ["eng", "fre"], True)
    assert (got["pg:7"].author, got["pg:7"].subjects, got["gb:g"].title, got["gb:g"].full_text, got["gb:h"].title) == ("P, Q", ["s", "b"], "T: U", False, "Untitled")
    assert sorted((r.answer, r.error) for r in S.errors(table).collect()) == [(5, "not JSON of this catalogue"), (6, "no answer"), (7, "no answer"), (9, "unknown catalogue"), (10, "unknown catalogue"), (11, "not JSON of this catalogue")]


def test_files(spark):
    xml = '<files><file name="a"><format>T</format></file><file><size>3</size></file><file name="b"><size>12x</size></file></files>'
    items = [("j", '{"files":[{"name":"x","size":"5"},{"size":"1"}]}', xml), ("x", None, xml), ("e", '{"files":[]}', None), ("b", "nonsense", "<files>")]
    got = sorted((r.item, r.name or "", r.format, r.size, r.how) for r in S.item_files(spark.createDataFrame(items, "item string, metadata string, files_xml string")).collect())
    assert got == [("b", "", "", 0, "error"), ("e", "", "", 0, "error"), ("j", "x", "", 5, "json"), ("x", "a", "T", 0, "xml"), ("x", "b", "", 0, "xml")]
