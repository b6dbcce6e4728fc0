from urllib.parse import urljoin

from lectern.llm.url_filter import declared_edges, filter_pages, resolved

BASE = "http://h.net/a/b/page.html?q#t"
REFS = ["/es/1", "page2.html", "../x", "../../../x/./y/..", "./", "..", "//example.org/es/1", "?k=1", "#z", "http://o.net/a/../b", "HTTPS://O.net", "a/b?u=../c", "/"]


def test_resolved(spark):
    from pyspark.sql import functions as F

    rows = [(r, b) for r in REFS for b in (BASE, "http://h.net", "https://h.net/dir/")] + [("mailto:x@y", BASE), ("x", "no-scheme"), ("", BASE)]
    got = {(x.r, x.b): x.u for x in spark.createDataFrame(rows, "r string, b string").select("r", "b", resolved(F.col("r"), F.col("b")).alias("u")).collect()}
    for (r, b), u in got.items():
        if r.startswith(("h", "H")) or r in ("mailto:x@y", "") or b == "no-scheme":
            assert u == (r if "://" in r else "")
        else:
            assert u == urljoin(b, r), (r, b)


def test_relative_targets_block(spark):
    link = "<link rel='canonical' href='{}'>".format
    pages = [
        (1, "http://www.example.org/free", link("/es/1")),
        (2, "http://www.example.org/es2/x", '<meta http-equiv="refresh" content="0; url=../es/1">'),
        (3, "http://mirror.net/p", link("//bad.com/de/1")),
        (4, "http://bad.com/x", "<base href='/de/'>" + link("page.html")),
        (5, "http://fine.net/p", link("q")),
        (6, "http://fine.net/q", ""),
    ]
    rules = (("block", "example.org/es/"), ("block", "bad.com/de/"))
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {x.page_id: x.verdict for x in filter_pages(table, rules).collect()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow"}
    assert declared_edges(table).count() == 5


def test_what_declares_links(spark):
    """Each page names http://bad.com/de/1; only some of them declare it."""
    bad = "http://bad.com/de/1"
    linking = [
        f'<link rel="nofollow  CANONICAL" href="{bad}">',
        f"<link data-href='q' rel=canonical href={bad}>",
        f'<LINK title="a > b" rel="canonical" href=" {bad} ">',
        f"<link rel='canonical'\n href\n=\n'{bad}'/>",
        f'<meta http-equiv=refresh content="5; URL=\'{bad}\'">',
        f"<meta content='0;url={bad}' http-equiv='Refresh'>",
        f"<!-- one --><link rel=canonical href='{bad}'><!-- two -->",
        f"<title>Is it <!-- so?</title><link rel=canonical href='{bad}'>",
    ]
    idle = [
        f"<!-- <link rel=canonical href='{bad}'> -->",
        f"<script>var x = '<link rel=canonical href={bad}>'</script>",
        f"<!-- never closed <link rel=canonical href='{bad}'>",
        f"<link rel=alternate data-rel=canonical href='{bad}'>",
        f"<link rel=canonical data-href='{bad}'>",
        f"<link rel=alternate title='rel=canonical' href='{bad}'>",
        f"<link rel=noncanonical href='{bad}'>",
        f"<meta name=description content='0; url={bad}' data-http-equiv=refresh>",
        f"<textarea><link rel=canonical href='{bad}'></textarea>",
        None,
    ]
    pages = [(k, f"http://h{k}.net/p", html) for k, html in enumerate([*linking, *idle])]
    pages += [(100, "http://blank.net/p", "<link rel=canonical href='http://bad.com/de/a b c'>"), (101, "http://bad.com/x y", ""), (102, "http://n.net/p", "<link rel=canonical href='http://bad.com/x y'>")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    edges = {(x.a, x.b) for x in declared_edges(table).collect()}
    want = {(f"http://h{k}.net/p", bad) for k in range(len(linking))} | {("http://blank.net/p", "http://bad.com/de/a b c"), ("http://n.net/p", "http://bad.com/x y")}
    assert edges == want
    blocked = {x.page_id for x in filter_pages(table, (("block", "bad.com/de/"),)).collect() if x.verdict == "block"}
    assert blocked == {*range(len(linking)), 100}
