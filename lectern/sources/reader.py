"""Files of any format to chapters and paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import containers, lightweight, xml_formats
from .book import Book, plain_text
from .decode import text_of_bytes
from .detect import DOUBTFUL, WHY_BLOCKED, by_name, extension, file_title, sniff

PARAGRAPHS = "path string, book int, format string, title string, author string, language string, c int, chapter string, p int, text string, error string"

_TEXT = {"md": lightweight.markdown, "srt": lightweight.subtitles, "tex": lightweight.latex, "html": xml_formats.html, "txt": plain_text}
_BYTES = {"epub": containers.epub, "docx": containers.docx, "odt": containers.odt, "cbz": containers.comic, "pdb": containers.palm, "mobi": containers.palm}
_XML = {"fb2": xml_formats.fictionbook, "xml": xml_formats.generic, "fodt": lambda data, title: xml_formats.opendocument(data, None, title)}


def parse_file(name: str | None, data: bytes, declared: str | None = None) -> Iterator[Book]:
    """The books in a file; ValueError says why there is none."""
    kind, title = by_name(name, declared), file_title((name or "").rpartition("/")[2])
    if kind == "blocked":
        raise ValueError(f"cannot be read: {WHY_BLOCKED[extension(name)]}")
    if kind in DOUBTFUL:
        kind = sniff(data, kind)
    if kind in _TEXT:
        yield _TEXT[kind](text_of_bytes(data), title)
    elif kind == "rtf":
        yield lightweight.rtf(data.decode("latin-1"), title)
    elif kind in _XML:
        yield _XML[kind](data, title)
    elif kind in _BYTES:
        yield _BYTES[kind](data, title)
    elif kind == "zip":
        yield from containers.bundle(data, title)
    else:
        raise ValueError(f"cannot be read: {'page images or a PDF need their text extracted first' if kind in ('pdf', 'image') else 'unknown format'}")


def _rows(path: str | None, data: bytes) -> Iterator[tuple]:
    try:
        for n, book in enumerate(parse_file(path, data)):
            if not book.chapters:
                raise ValueError("no readable text")
            for c, (title, paras) in enumerate(book.chapters):
                for p, text in enumerate(paras):
                    yield path, n, book.format, book.title, book.author, book.language, c, title, p, text, None
    except Exception as problem:  # a broken file is a row with an error and not a broken job
        yield path, 0, None, None, None, None, None, None, None, None, f"{type(problem).__name__}: {problem}"[:500]


#: Rows and characters that go on at once.
OUT_ROWS, OUT_CHARS = 5000, 1 << 20
_SCHEMA = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in PARAGRAPHS.split(", ")])


def parse_files(files: DataFrame) -> DataFrame:
    """PARAGRAPHS of files (path, content). Of a batch one file at a time is taken apart; output goes on in small batches, by rows and characters."""

    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                for row in _rows(path.as_py(), content.as_py()):
                    held.append(row)
                    size += len(row[9] or "")
                    if len(held) >= OUT_ROWS or size >= OUT_CHARS:
                        yield out(held)
                        held, size = [], 0
            if held:
                yield out(held)

    return files.select("path", "content").mapInArrow(run, PARAGRAPHS)


def read_books(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return parse_files(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))


def books(paragraphs: DataFrame) -> DataFrame:
    """One row per book: metadata and counts."""
    rows = paragraphs.filter("error is null").groupBy("path", "book")
    return rows.agg(*[F.first(c).alias(c) for c in ("format", "title", "author", "language")], F.count_distinct("c").alias("chapters"), F.count("*").alias("paragraphs"), F.sum(F.regexp_count("text", F.lit(r"\S+"))).cast("long").alias("words"))
