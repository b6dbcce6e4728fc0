"""Files of odd documents against the DuckDB twins."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern import registry
from lectern.sources.detect import sniff_column

registry.load()


def both(spark, folder, name, rows):
    """Rows of a query and of its SQL over documents (doc_id, text)."""
    ids, texts = zip(*rows, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())}), f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    result = con.execute(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, str(folder)).select([d[0] for d in result.description])
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, result.fetchall()))


def test_documents_without_paragraphs_have_a_format(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \n\t\r\n"), (4, "A text.\nOf two lines."), (4, "a second row"), (None, "no id"), (None, None), (5, "%PDF <html> \\section{x}")]
    got, want = both(spark, tmp_path, "sniff_type", rows)
    assert got == want and len(got) == 7 * len(rows)


@pytest.mark.parametrize("kind", ["md", "html", "fb2", "xml", "tex", "rtf", "docx", "odt", "fodt", "epub", "pdb", "ztxt", "srt"])
def test_files_without_a_name_are_parsed(spark, tmp_path, kind):
    got, want = both(spark, tmp_path, f"parse_{kind}", [(1, None), (2, " \n"), (3, "One text of five words.\nAnd a line more."), (None, "This one has no id.\nStill it is read.")])
    assert got == want and len(got) == 2


def test_first_bytes_are_decoded_once(spark):
    """Once for what a format begins with and once for text; each way to write it finds its format."""
    cases = [(b"%PDF-1.4", "pdf"), (b"z" * 60 + b"BOOKMOBI", "mobi"), (b"z" * 61 + b"BOOKMOBI", "txt"), (b"\xef\xbb\xbf \r\n<!DOCTYPE TEI>", "xml"), (b"\n7\r\n0:01 --> 0:02", "srt"), (b" 0:01:02,3,0:01:04", "srt"), (b"7 --> 8", "txt"), (b"a\n# b\nc", "md"), (b"a \\chapter{b}", "tex"), (b"a\0", None), (b"", None), (None, None)]
    rows = spark.createDataFrame([(k, content and bytearray(content)) for k, (content, _) in enumerate(cases)], "k int, content binary")
    got = rows.select("k", sniff_column(F.col("content")).alias("kind"))
    assert [r.kind for r in got.orderBy("k").collect()] == [kind for _, kind in cases]
    assert got._jdf.queryExecution().executedPlan().toString().count("decode(") == 2
