import pytest

from lectern.sources import book, containers, detect, lightweight, xml_formats
from lectern.sources.decode import text_of_bytes
from lectern.sources.reader import parse_file, parse_files
from lectern.sources.render import render

CHAPTERS = [("Chapter One", ["The first paragraph, with “quotes” & an angle.", "Été à la côte; 100% of it."]), ("Chapter Two", ["Another one here, plain words only.", "Last words of the book."])]
FLAT = [p for _, paras in CHAPTERS for p in paras]


@pytest.mark.parametrize("kind", ["md", "html", "fb2", "xml", "tex", "rtf", "docx", "odt", "fodt", "epub"])
def test_same_chapters(kind):
    (got,) = parse_file(f"x.{kind}", render(kind, "A Title", "An Author", CHAPTERS))
    assert got.title == "A Title" and got.chapters == CHAPTERS
    assert got.author == "An Author" or kind == "xml"


@pytest.mark.parametrize(("kind", "ext"), [("pdb", "pdb"), ("ztxt", "pdb"), ("mobi", "mobi"), ("txt", "txt"), ("zip", "zip"), ("srt", "srt"), ("vtt", "vtt")])
def test_same_text(kind, ext):
    (got,) = parse_file(f"x.{ext}", render(kind, "A Title", "An Author", CHAPTERS))
    text = " ".join(p for _, paras in got.chapters for p in paras)
    for p in FLAT:
        assert p in text


def test_comic():
    (got,) = parse_file("x.cbz", render("cbz", "T", "W", CHAPTERS))
    assert got.title == "T" and len(got.chapters[0][1]) == 2
    assert containers.comic(render("cbz", "T", "W", CHAPTERS), texts={"page2.jpg": "Hi  there"}).chapters == [("Pages", ["Hi there"])]


def test_palmdoc():
    assert containers.palmdoc(b"abc" + bytes([0x80, 3 << 3 | 3]) + bytes([0xC0 | 0x41 & 0x3F | 0x40]) + b"\x02\xff\xfe") == b"abcabcabc" + bytes([32, 0x41]) + b"\xff\xfe"


def test_latex_accents():
    assert lightweight.latex_inline(r"\'Et\'e caf\'{e} na\"{\i}ve \c{c}a $x^2$ \emph{word} \cite{k} a---b ``q''") == "Été café naïve ça word a—b “q”"


def test_markdown_blocks():
    got = lightweight.markdown_blocks("Title\n=====\n\nSome *soft*\ntext [a](b).\n\n- one\n- two\n\n```\ncode\n```\n\n| h |\n|---|\n| c |\n")
    assert [(b.text, b.level) for b in got] == [("Title", 1), ("Some soft text a.", 0), ("• one", 0), ("• two", 0), ("code", 0), ("| c |", 0)]


def test_cues():
    src = "WEBVTT\n\nNOTE x\n\n1\n00:00:00.000 --> 00:00:01.000\n<i>Hello</i>\n\n2\n00:00:01.000 --> 00:00:02.000\nHello\n\n3\n00:00:02.000 --> 00:00:03.000\nyou {\\an8}there."
    assert lightweight.cues(src) == ["Hello", "you there."]
    assert lightweight.join_cues(["x" * 451 + ".", "y", "z."]) == ["x" * 451 + ".", "y z."]


def test_plain_text():
    got = book.plain_text("My Book\n\nby Some One\n\n\nBOOK ONE\n\nCHAPTER I\n\nIt was _so_ nice a day that all of us who were there in the house\nwent out.\n\nCHAPTER II\n\nMore of it came after, as it always did.\n")
    assert (got.title, got.author) == ("My Book", "Some One")
    assert [t for t, _ in got.chapters] == ["BOOK ONE · CHAPTER I", "CHAPTER II"]
    assert got.chapters[0][1] == ["It was so nice a day that all of us who were there in the house went out."]
    contents = book.plain_text("CHAPTER I\n\nCHAPTER II\n\nCHAPTER III\n\nCHAPTER IV\n\nText that follows the contents of it.")
    assert contents.chapters == [("Front matter", ["Text that follows the contents of it."])]


def test_refine():
    mark = "*** {} OF THE PROJECT GUTENBERG EBOOK X ***"
    got = book.refine([("a", ["licence", mark.format("START"), "text one"]), ("b", ["text two", mark.format("END"), "licence"])])
    assert got == [("a", ["text one"]), ("b", ["text two"])]


def test_rtf_details():
    dash = chr(92) + "u8212?"
    got = lightweight.rtf(r"{\rtf1\ansi\ansicpg1252\uc1{\*\generator x;}{\info{\title A}{\author B}}\pard caf\'e9 " + dash + r" dash\line two\par{\footnote no}\pard\outlinelevel0 Head\par\pard body {\b bold} text\par}")
    assert got.title == "A" and got.author == "B"
    assert got.chapters == [("A", ["café — dash\ntwo"]), ("Head", ["body bold text"])]


def test_feed_and_flat():
    feed = "<rss><channel><title>F</title><item><title>One</title><description>&lt;p&gt;Body text&lt;/p&gt;</description></item></channel></rss>"
    assert xml_formats.generic(feed).chapters == [("One", ["Body text"])]


def test_detect():
    assert detect.by_name("a.FB2.zip") == "zip" and detect.by_name("x.kfx") == "blocked" and detect.by_name("x", "text/css") == "txt" and detect.by_name("x") is None
    for kind in ("docx", "odt", "epub", "cbz", "zip"):
        (b,) = [*parse_file("x.zip", render(kind, "T", "A", CHAPTERS))][:1]
        assert b.format in (kind, "txt")
    assert detect.sniff(b"%PDF-1.4") == "pdf" and detect.sniff(b"\0\1\2") is None and detect.sniff(b"plain words") == "txt" and detect.sniff(b"# Head\n\ntext", "txt") == "md"


def test_decode():
    for codec, mark in (("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")):
        assert text_of_bytes(mark + "été".encode(codec)) == "été"
    assert text_of_bytes("<?xml encoding='iso-8859-1'?>été".encode("latin-1")).endswith("été")
    assert text_of_bytes("été “x”".encode("cp1252")) == "été “x”"


def test_errors_are_rows(spark):
    rows = [("a.docx", b"not a zip"), ("b.kfx", b"x"), ("c.txt", b""), ("d.md", b"# H\n\nsome text here")]
    got = {r.path: r.error for r in parse_files(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")).collect()}
    assert got["d.md"] is None and all(got[p] for p in ("a.docx", "b.kfx", "c.txt"))
