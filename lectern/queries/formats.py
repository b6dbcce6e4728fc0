"""Parsers held against what was written: documents are rendered in each format and read back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators.narration import by_size
from ..plans.corpus import CHAPTER, visible_lines
from ..registry import query, table
from ..sources.detect import sniff_column
from ..sources.reader import books, parse_files
from ..sources.render import render
from . import sql

KINDS = ("md", "html", "fb2", "xml", "tex", "rtf", "docx", "odt", "fodt", "epub", "pdb", "ztxt", "srt")


def _rendered(spark, sf_dir, *kinds, blank=False):
    """(path, content): each document with paragraphs as a file of each kind, its chapters named Chapter 1, 2, … No shuffle: a document's
    paragraphs are in its own row. A block of rows is in memory at a time. blank: documents without paragraphs are files too. Without an id
    a document has no path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", visible_lines(F.col("text")).alias("lines"))
    docs = docs if blank else docs.filter(F.size("lines") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in by_size(batch, 1):
                paths, files = [], []
                for doc, lines in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                    chapters = [(f"Chapter {k // CHAPTER + 1}", lines[k : k + CHAPTER]) for k in range(0, len(lines), CHAPTER)]
                    for kind in kinds:
                        paths.append(None if doc is None else f"{doc}.{'pdb' if kind == 'ztxt' else kind}")
                        files.append(render(kind, f"Title {doc}", f"Author {doc}", chapters))
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(files, pa.binary())], names=["path", "content"])

    return docs.mapInArrow(run, "path string, content binary")


_TEXTS = f"WITH {sql.PARAS}, v AS (SELECT * FROM paras WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')), k AS (SELECT doc_id, c, count(*) AS n, sum(pwc) AS w FROM v GROUP BY ALL)"
_COUNTS = "SELECT doc_id, count(*) AS chapters, CAST(sum(n) AS BIGINT) AS paragraphs, CAST(sum(w) AS BIGINT) AS words FROM k {} GROUP BY doc_id"


def _round_trip(kind):
    def run(spark, sf_dir):
        got = books(parse_files(_rendered(spark, sf_dir, kind)))
        return got.select(F.split("path", r"\.")[0].cast("long").alias("doc_id"), "chapters", "paragraphs", "words")

    run.__name__ = f"parse_{kind}"
    return run


for _kind in KINDS:
    if _kind == "srt":  # cues join into paragraphs: only words are comparable
        continue
    # EPUB leaves out parts of fewer than five words, title included.
    query(f"{_TEXTS} {_COUNTS.format('WHERE w >= 3' if _kind == 'epub' else '')}")(_round_trip(_kind))


@query(f"WITH {sql.PARAS}, d AS (SELECT *, lag(trim(regexp_replace(text, '\\s+', ' ', 'g'))) OVER (PARTITION BY doc_id ORDER BY c, p) AS prev FROM paras) SELECT doc_id, CAST(sum(pwc) AS BIGINT) AS words FROM d WHERE prev IS NULL OR prev <> trim(regexp_replace(text, '\\s+', ' ', 'g')) GROUP BY doc_id")
def parse_srt(spark, sf_dir):
    got = books(parse_files(_rendered(spark, sf_dir, "srt")))
    return got.select(F.split("path", r"\.")[0].cast("long").alias("doc_id"), "words")


@query("SELECT CAST(doc_id AS VARCHAR) || '.' || k AS path, CASE k WHEN 'ztxt' THEN 'pdb' WHEN 'docx' THEN 'zip' WHEN 'odt' THEN 'zip' WHEN 'epub' THEN 'zip' ELSE k END AS kind FROM documents, (SELECT unnest(['html', 'fb2', 'rtf', 'docx', 'tex', 'fodt', 'pdb']) AS k)")
def sniff_type(spark, sf_dir):
    """Formats by first bytes, inside Catalyst. A document without paragraphs has a format all the same."""
    files = _rendered(spark, sf_dir, "html", "fb2", "rtf", "docx", "tex", "fodt", "pdb", blank=True)
    return files.select("path", sniff_column(F.col("content")).alias("kind"))
