"""EPUB, Word and OpenDocument packages, zip bundles, comics, and Palm databases."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

from .book import Book, is_contents, numbered, one_line, plain_text, refine, section
from .decode import text_of_bytes
from .detect import file_title, natural_key, zip_kind
from .xml_formats import all_of, attribute, find, html_parts, local, opendocument, parse, text_of, word_document

_HIDDEN = re.compile(r"(?:^|/)(?:__MACOSX|\.[^/]*|thumbs\.db|desktop\.ini)(?:/|$)", re.I)


class Package:
    """A zip file whose entries are found whatever their case."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = [n for n in self.zip.namelist() if not n.endswith("/") and not _HIDDEN.search(n)]
        self.lower = {n.lower(): n for n in reversed(self.names)}

    def get(self, path: str) -> bytes | None:
        name = path if path in self.names else self.lower.get(path.lower())
        return self.zip.read(name) if name else None


def resolve(base: str, href: str) -> str:
    href = unquote(re.split("[?#]", href)[0])
    return href[1:] if href.startswith("/") else posixpath.normpath(posixpath.join(base, href)).removeprefix("../")


def _toc(package: Package, items: dict[str, tuple[str, str, str]], base: str) -> dict[str, str]:
    """Titles by path, from the navigation document or the older table; the first title of a path counts."""
    out: dict[str, str] = {}
    nav = next((i for i in items.values() if "nav" in i[2].split()), None)
    if nav and (data := package.get(nav[0])):
        for a in all_of(parse(data), "a"):
            if (href := attribute(a, "href")) and text_of(a):
                out.setdefault(resolve(posixpath.dirname(nav[0]), href).lower(), text_of(a))
    ncx = next((i for i in items.values() if "ncx" in i[1]), None)
    if not out and ncx and (data := package.get(ncx[0])):
        for point in all_of(parse(data), "navPoint"):
            content = find(point, "content")
            if content is not None and text_of(find(point, "text")):
                out.setdefault(resolve(posixpath.dirname(ncx[0]), attribute(content, "src")).lower(), text_of(find(point, "text")))
    return out


def epub(data: bytes, title: str = "") -> Book:
    package = Package(data)
    if package.get("META-INF/encryption.xml") and package.get("META-INF/rights.xml"):
        raise ValueError("the book is copy-protected")
    container = package.get("META-INF/container.xml")
    path = attribute(find(parse(container), "rootfile"), "full-path") if container else next(n for n in package.names if n.lower().endswith(".opf"))
    opf = parse(package.get(path) or b"")
    base = posixpath.dirname(path)
    items = {attribute(i, "id"): (resolve(base, attribute(i, "href")), attribute(i, "media-type"), attribute(i, "properties")) for i in all_of(opf, "item")}
    meta = find(opf, "metadata")
    book = Book(format="epub", title=text_of(find(meta, "title")) or title, author=", ".join(text_of(c) for c in all_of(meta, "creator")), language=text_of(find(meta, "language"))[:8], subjects=[text_of(s) for s in all_of(meta, "subject")], description=text_of(find(meta, "description")))
    titles = _toc(package, items, base)
    found: list[tuple[str, list[str]]] = []
    for ref in all_of(opf, "itemref"):
        item = items.get(attribute(ref, "idref"))
        if not item or "html" not in item[1] or "nav" in item[2].split() or not (page := package.get(item[0])):
            continue
        blocks = html_parts(text_of_bytes(page)).blocks
        name = titles.get(item[0].lower(), "")
        if not is_contents(blocks, name):
            found += section(blocks, name, anywhere=True)
    book.chapters = refine(numbered(found))
    return book


def docx(data: bytes, title: str = "") -> Book:
    package = Package(data)
    return word_document(package.get("word/document.xml") or b"", package.get("word/styles.xml"), package.get("docProps/core.xml"), title)


def odt(data: bytes, title: str = "") -> Book:
    package = Package(data)
    return opendocument(package.get("content.xml") or b"", package.get("meta.xml"), title)


def comic(data: bytes, title: str = "", texts: dict[str, str] | None = None) -> Book:
    """Pages in natural order; what is written on them comes from `texts` (recognised elsewhere), by entry name."""
    package = Package(data)
    book = Book(format="cbz", title=title)
    if info := package.get("ComicInfo.xml"):
        root = parse(info)
        series, number = text_of(find(root, "Series")), text_of(find(root, "Number"))
        book.title = text_of(find(root, "Title")) or one_line(f"{series} {number}") or title
        book.author, book.description = text_of(find(root, "Writer")), text_of(find(root, "Summary"))
        book.language = text_of(find(root, "LanguageISO"))[:8]
    pages = sorted((n for n in package.names if re.search(r"\.(jpe?g|png|webp|gif|bmp|tiff?|avif)$", n, re.I)), key=natural_key)
    paras = [t for n in pages if (t := one_line((texts or {}).get(n)))]
    book.chapters = [("Pages", paras or [f"Page {k + 1}: {posixpath.basename(n)}" for k, n in enumerate(pages)])] if pages else []
    return book


def bundle(data: bytes, title: str = "") -> Iterator[Book]:
    """Books in a bundle: each that is a book by itself, or one book of all plain texts in natural order."""
    from .reader import parse_file

    package = Package(data)
    kind = zip_kind(package.names)
    if kind != "zip":
        yield from parse_file(f"{title}.{kind}", data)
        return
    texts, books = [], []
    for name in sorted(package.names, key=natural_key):
        ext = name.rpartition(".")[2].lower()
        (texts if ext in ("txt", "text") else books).append(name)
    for name in books:
        if name.rpartition(".")[2].lower() not in ("jpg", "jpeg", "png", "gif", "opf", "ncx", "css", "db", "ini"):
            yield from (b for b in parse_file(posixpath.basename(name), package.get(name) or b"") if b.chapters)
    if len(texts) == 1:
        yield from parse_file(posixpath.basename(texts[0]), package.get(texts[0]) or b"")
    elif texts:
        chapters = []
        for name in texts:
            got = plain_text(text_of_bytes(package.get(name) or b"")).chapters
            chapters += [(file_title(posixpath.basename(name)) if len(got) == 1 else t, p) for t, p in got]
        yield Book(title=title, format="zip", chapters=chapters)


# ---- Palm databases

def palmdoc(data: bytes) -> bytes:
    """PalmDoc decompression: literals, runs of literals, a space with a letter, and copies from what is already there."""
    out = bytearray()
    at = 0
    while at < len(data):
        b = data[at]
        at += 1
        if 1 <= b <= 8:
            out += data[at : at + b]
            at += b
        elif b < 0x80:
            out.append(b)
        elif b >= 0xC0:
            out += bytes((32, b ^ 0x80))
        elif at < len(data):
            pair = (b << 8 | data[at]) & 0x3FFF
            at += 1
            back, n = pair >> 3, (pair & 7) + 3
            for _ in range(n):
                out.append(out[-back] if 0 < back <= len(out) else 32)
    return bytes(out)


def _records(data: bytes) -> list[bytes]:
    n = struct.unpack(">H", data[76:78])[0]
    starts = [struct.unpack(">I", data[78 + 8 * k : 82 + 8 * k])[0] for k in range(n)] + [len(data)]
    return [data[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def palm(data: bytes, title: str = "") -> Book:
    """PalmDoc and zTXT text; and MOBI files of the older kind (no HUFF compression, no protection), whose text is HTML."""
    kind, name = data[60:68], data[:32].split(b"\0")[0].decode("cp1252").replace("_", " ").strip()
    records = _records(data)
    head = records[0]
    if kind == b"zTXTGPlm":
        count = struct.unpack(">H", head[2:4])[0]
        unpack = zlib.decompressobj()
        text = text_of_bytes(b"".join(unpack.decompress(r) for r in records[1 : count + 1]))
        book = plain_text(text, name or title)
        book.format = "pdb"
        return book
    compression, _, _, count = struct.unpack(">HHIH", head[:10])
    if compression == 17480:
        raise ValueError("HUFF compression is not supported")
    if kind == b"BOOKMOBI" and struct.unpack(">H", head[12:14])[0]:
        raise ValueError("the book is copy-protected")
    parts = [palmdoc(r) if compression == 2 else r for r in records[1 : count + 1]]
    if kind == b"BOOKMOBI":
        utf8 = len(head) >= 32 and struct.unpack(">I", head[28:32])[0] == 65001
        got = html_parts(b"".join(parts).decode("utf-8" if utf8 else "cp1252", "replace"))
        at, size = struct.unpack(">II", head[84:92]) if len(head) >= 92 else (0, 0)
        full = head[at : at + size].decode("utf-8" if utf8 else "cp1252", "replace") if size else name
        return Book(title=full or title, format="mobi", chapters=refine(numbered(section(got.blocks, full or title, anywhere=True))))
    book = plain_text(text_of_bytes(b"".join(parts)), name or title)
    book.format = "pdb"
    return book


__all__ = ["Package", "bundle", "comic", "docx", "epub", "local", "odt", "palm", "palmdoc", "resolve"]
