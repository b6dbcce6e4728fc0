"""FictionBook, HTML, OpenDocument and Word text, feeds, DocBook and TEI."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

from ..operators.markup import BLOCKS, DROPPED
from .book import Block, Book, by_headings, from_blocks, numbered, one_line, refine, visible, words


def local(el: ET.Element) -> str:
    return el.tag.rpartition("}")[2] if isinstance(el.tag, str) else ""


def text_of(el: ET.Element | None) -> str:
    return one_line("".join(el.itertext())) if el is not None else ""


def find(el: ET.Element | None, name: str) -> ET.Element | None:
    return next(all_of(el, name), None)


def all_of(el: ET.Element | None, name: str) -> Iterator[ET.Element]:
    return (x for x in (el.iter() if el is not None else ()) if local(x) == name)


def attribute(el: ET.Element, name: str) -> str:
    return next((v for k, v in el.attrib.items() if k.rpartition("}")[2] == name), "")


def parse(source: str | bytes) -> ET.Element:
    """A strict parse; unknown entities, which office files and old books hold, become spaces first."""
    try:
        return ET.fromstring(source)
    except ET.ParseError:
        text = source.decode("utf-8", "replace") if isinstance(source, bytes) else source
        text = re.sub(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)\w*;?", " ", re.sub(r"<\?xml[^>]*\?>", "", text, count=1))
        return ET.fromstring(text.strip())


# ---- FictionBook

_FB2_TEXT = {"p", "v", "subtitle", "text-author", "td", "th"}


def _fb2_paras(el: ET.Element) -> Iterator[str]:
    for child in el:
        name = local(child)
        if name in ("section", "title", "image", "binary"):
            continue
        if name in _FB2_TEXT:
            if t := text_of(child):
                yield t
        else:
            yield from _fb2_paras(child)


def _fb2_title(el: ET.Element) -> str:
    own = next((c for c in el if local(c) == "title"), None)
    return (" · ".join(t for p in all_of(own, "p") if (t := text_of(p))) or text_of(own)) if own is not None else ""


def _fb2_sections(el: ET.Element, prefix: str, depth: int) -> Iterator[tuple[str, list[str]]]:
    own, paras = _fb2_title(el), list(_fb2_paras(el))
    if paras:
        yield " · ".join(x for x in (prefix, own) if x), paras
    if depth <= 6:
        for child in (c for c in el if local(c) == "section"):
            yield from _fb2_sections(child, "" if paras else own or prefix, depth + 1)


def fictionbook(source: str | bytes, title: str = "") -> Book:
    root = parse(source)
    info = find(root, "title-info")
    book = Book(format="fb2", title=text_of(find(info, "book-title")), language=text_of(find(info, "lang"))[:8], description=text_of(find(info, "annotation")))
    names = [" ".join(t for n in ("first-name", "middle-name", "last-name") if (t := text_of(find(a, n)))) or text_of(find(a, "nickname")) for a in all_of(info, "author")]
    book.author = ", ".join(n for n in names if n)
    book.subjects = [text_of(g).replace("_", " ") for g in all_of(info, "genre") if text_of(g)]
    bodies = [b for b in root if local(b) == "body"]
    found: list[tuple[str, list[str]]] = []
    for body in bodies:
        if re.search("notes|comments|footnotes", body.get("name", ""), re.I):
            continue
        direct = list(_fb2_paras(body))
        if direct:
            found.append((_fb2_title(body) or book.title or "Text", direct))
        for sec in (c for c in body if local(c) == "section"):
            found += _fb2_sections(sec, _fb2_title(body) if len(bodies) > 1 and not direct else "", 0)
    book.title = book.title or title
    book.chapters = refine(numbered(found))
    return book


# ---- HTML

_VOID = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Html(HTMLParser):
    """Blocks of (possibly broken) HTML; text inside dropped tags and media is left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.title, self.author, self.language = "", "", ""
        self.buffer: list[str] = []
        self.level, self.off, self.in_title, self.pre, self.in_head = 0, 0, False, 0, False

    def flush(self) -> None:
        text = "".join(self.buffer)
        self.buffer.clear()
        if self.level:
            text = one_line(text)
        elif self.pre:
            text = re.sub(r"\n{3,}", "\n\n", text.replace("\r", "")).strip()
        else:
            text = re.sub(r"\n{2,}", "\n", re.sub(r" {2,}", " ", re.sub(r"[ \t]*\n[ \t]*", "\n", text))).strip()
        if visible(text):
            self.blocks.append(Block(text, self.level))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        have = dict(attrs)
        if tag == "html":
            self.language = (have.get("lang") or have.get("xml:lang") or "")[:5]
        elif tag == "meta" and (have.get("name") or "").lower() == "author":
            self.author = have.get("content") or ""
        elif tag == "title":
            self.in_title = True
        elif tag == "head":
            self.in_head = True
        elif tag in DROPPED:
            self.off += 1
        elif tag == "br":
            self.buffer.append("\n" if not self.level else "")
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.level = int(tag[1])
        elif tag in BLOCKS:
            self.in_head = False
            self.flush()
            self.pre += tag == "pre"

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        elif tag == "head":
            self.in_head = False
        elif tag in DROPPED:
            self.off = max(0, self.off - 1)
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.level = 0
        elif tag in BLOCKS:
            self.flush()
            self.pre = max(0, self.pre - (tag == "pre"))

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.off and not self.in_head:
            self.buffer.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_parts(source: str) -> _Html:
    parser = _Html()
    parser.feed(source)
    parser.close()
    parser.flush()
    return parser


def html(source: str, title: str = "") -> Book:
    got = html_parts(source)
    name = one_line(got.title) or title
    return Book(title=name, author=got.author, language=got.language, chapters=by_headings(got.blocks, name), format="html")


# ---- OpenDocument

_ODF_SKIP = "annotation annotation-end tracked-changes deletion note note-citation note-body sequence-decls variable-decls user-field-decls forms index-title-template table-of-content alphabetical-index illustration-index bibliography user-index object-index".split()


def _odf_text(el: ET.Element) -> str:
    out = [el.text or ""]
    for child in el:
        name = local(child)
        if name == "s":
            out.append(" " * int(attribute(child, "c") or 1))
        elif name == "tab":
            out.append(" ")
        elif name == "line-break":
            out.append("\n")
        elif name not in _ODF_SKIP:
            out.append(_odf_text(child))
        out.append(child.tail or "")
    return "".join(out)


def _odf_blocks(el: ET.Element) -> Iterator[Block]:
    for child in el:
        name = local(child)
        if name in _ODF_SKIP:
            continue
        if name in ("h", "p"):
            if t := one_line(_odf_text(child)):
                yield Block(t, int(attribute(child, "outline-level") or 1) if name == "h" else 0)
        else:
            yield from _odf_blocks(child)


def opendocument(content: str | bytes, meta: str | bytes | None = None, title: str = "") -> Book:
    """Content and metadata of an OpenDocument file; a flat one is handed in as both."""
    root = parse(content)
    head = parse(meta) if meta else root
    blocks = list(_odf_blocks(find(root, "text") if find(root, "text") is not None else root))
    book = Book(format="odt", title=text_of(next((x for x in head.iter() if local(x) == "title" and "dc/" in x.tag), None)) or title, language=text_of(find(head, "language"))[:8])
    book.author = text_of(find(head, "initial-creator")) or text_of(find(head, "creator"))
    book.chapters = from_blocks(blocks, book.title)
    return book


# ---- Word

#: What heading styles are called in some languages.
_HEADING_NAMES = "heading titre überschrift berschrift título titolo kop rubrik overskrift nagłówek заголовок".split()


def word_document(document: bytes, styles: bytes | None = None, core: bytes | None = None, title: str = "") -> Book:
    levels: dict[str, int] = {}
    for style in all_of(parse(styles), "style") if styles else ():
        name = next((attribute(x, "val") for x in style if local(x) == "name"), "").lower()
        outline = find(style, "outlineLvl")
        m = re.match(rf"(?:{'|'.join(_HEADING_NAMES)})\s*(\d)", name)
        if outline is not None and attribute(outline, "val").isdigit():
            levels[attribute(style, "styleId")] = int(attribute(outline, "val")) + 1
        elif m or name == "title":
            levels[attribute(style, "styleId")] = int(m[1]) if m else 1
    blocks = []
    for p in all_of(parse(document), "p"):
        level, out = 0, []
        for el in p.iter():
            name = local(el)
            if name == "pStyle":
                own = attribute(el, "val")
                m = re.match(rf"(?:{'|'.join(_HEADING_NAMES)})\s*(\d)", own.lower())
                level = levels.get(own, int(m[1]) if m else 1 if own.lower() == "title" else 0)
            elif name == "outlineLvl":
                level = int(attribute(el, "val") or 9) + 1
            elif name == "t":
                out.append(el.text or "")
            elif name in ("tab",) and el.attrib.get("val") is None:
                out.append(" ")
            elif name in ("br", "cr"):
                out.append(" ")
            elif name == "noBreakHyphen":
                out.append("-")
        # Deleted text stands in delText and is never seen here.
        if t := one_line("".join(out)):
            blocks.append(Block(t, level if 0 < level <= 6 and words(t) <= 24 else 0))
    head = parse(core) if core else None
    book = Book(format="docx", title=text_of(find(head, "title")) or title, author=text_of(find(head, "creator")), language=text_of(find(head, "language"))[:8])
    book.chapters = from_blocks(blocks, book.title)
    return book


# ---- other XML

_HEADS, _PARAS = {"title", "head", "titleabbrev"}, {"para", "p", "simpara", "ab", "l", "lg", "formalpara", "verse", "line", "blockquote", "item", "listitem"}
_DIVISIONS = {"part": 1, "chapter": 1, "article": 1, "preface": 1, "appendix": 1, "div": 1, "div1": 1, "section": 2, "sect1": 2, "div2": 2}


def _xml_blocks(el: ET.Element | list[ET.Element], level: int) -> Iterator[Block]:
    for child in el:
        name = local(child).lower()
        if name in ("teiheader", "info", "bookinfo", "articleinfo", "note", "footnote", "indexterm", "figure", "table"):
            continue
        if name in _HEADS:
            if t := text_of(child):
                yield Block(t, level)
        elif name in _PARAS and not any(local(x).lower() in _PARAS for x in child):
            if t := text_of(child):
                yield Block(t)
        else:
            yield from _xml_blocks(child, _DIVISIONS.get(name, level))


def _feed(root: ET.Element) -> list[tuple[str, list[str]]]:
    out = []
    for item in (x for x in root.iter() if local(x) in ("item", "entry")):
        body = next((t for n in ("encoded", "content", "description", "summary") if (t := text_of(find(item, n)))), "")
        blocks = [b.text for b in html_parts(body).blocks]
        if blocks:
            out.append((text_of(find(item, "title")), blocks))
    return out


def generic(source: str | bytes, title: str = "") -> Book:
    """DocBook, TEI, feeds, and whatever has paragraphs; FictionBook, HTML and flat OpenDocument go to their own parsers."""
    text = source.decode("utf-8", "replace") if isinstance(source, bytes) else source
    if re.search(r"<FictionBook[\s>]", text[:4096], re.I):
        return fictionbook(source, title)
    if re.search(r"<!DOCTYPE\s+html|<html[\s>]", text[:4096], re.I):
        return html(text, title)
    root = parse(source)
    name = local(root)
    if name == "document" and "office" in root.tag:
        return opendocument(source, None, title)
    if name in ("rss", "feed", "RDF"):
        return Book(title=text_of(find(root, "title")) or title, chapters=numbered(_feed(root)), format="xml")
    book = Book(format="xml", title=text_of(find(root, "title")) or title, author=text_of(find(root, "author")), language=(attribute(root, "lang") or "")[:8])
    body = find(root, "body") if find(root, "body") is not None else root
    blocks = [b for child in body if local(child).lower() not in _HEADS for b in _xml_blocks([child], 1)]  # the book's own title is no chapter
    book.chapters = from_blocks(blocks, book.title) if blocks else []
    return book
