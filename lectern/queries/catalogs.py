"""Catalogue answers made of the test tables, ten records each, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, table
from ..sources import catalogs as S

#: Every seventh answer is cut in half, every eleventh is missing.
_CUT, _GONE = 7, 11


def _answers(rows, source, key, record, head, tail):
    """Answers of a source: the records of ten rows each, in the order of their key."""
    part = F.floor(F.col(key) / 10)
    made = rows.select(part.alias("answer"), F.col(key).alias("k"), record.alias("r")).groupBy("answer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]), ",").alias("list"))
    whole = F.concat(F.lit(head), "list", F.lit(tail))
    payload = F.when(F.col("answer") % _GONE == 5, F.lit(None)).when(F.col("answer") % _CUT == 3, F.substr(whole, F.lit(1), F.floor(F.length(whole) / 2).cast("int"))).otherwise(whole)
    return made.select(F.lit(source).alias("source"), "answer", payload.alias("payload"))


def _all(spark, sf_dir):
    part, supplier, customer, nation = (table(spark, sf_dir, t) for t in ("part", "supplier", "customer", "nation"))
    json = lambda *c: F.to_json(F.struct(*c))
    work = json(F.concat(F.lit("/works/"), "p_partkey").alias("key"), F.col("p_name").alias("title"), F.array("p_brand", F.lit("Anon")).alias("author_name"), (1900 + F.col("p_size")).alias("first_publish_year"), F.array("p_type", F.lit("Goods")).alias("subject"), F.when(F.col("p_size") % 2 == 0, F.array("p_brand")).alias("ia"), F.lit("public").alias("ebook_access"))
    # One creator as a value, two as an array; a title that is none.
    scan = F.when(F.col("s_suppkey") % 2 == 0, json(F.col("s_name").alias("identifier"), F.lit("One").alias("creator"), F.lit("a; b").alias("subject"), F.lit("1999-01").alias("year"))).otherwise(json(F.col("s_name").alias("identifier"), F.array(F.lit("Title"), F.lit("Other")).alias("title"), F.array(F.lit("One"), F.lit("Two"), F.lit("Three")).alias("creator"), F.array(F.lit("a"), F.lit("b;c")).alias("subject"), F.lit("old").alias("year"), F.col("s_suppkey").alias("downloads")))
    text = json(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.array(F.struct(F.col("c_mktsegment").alias("name"))).alias("authors"), F.array("c_mktsegment").alias("bookshelves"), F.col("c_custkey").alias("download_count"))
    volume = json(F.col("n_nationkey").cast("string").alias("id"), F.struct(F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 2 == 0, "II").alias("subtitle"), F.lit("1950-02-03").alias("publishedDate")).alias("volumeInfo"), F.struct((F.col("n_regionkey") == 1).alias("publicDomain"), F.struct(F.lit("u").alias("downloadLink")).alias("epub")).alias("accessInfo"))
    made = [_answers(part, "openlibrary", "p_partkey", work, '{"numFound":1,"docs":[', "]}"), _answers(supplier, "archive", "s_suppkey", scan, '{"response":{"docs":[', "]}}"), _answers(customer, "gutenberg", "c_custkey", text, '{"results":[', "]}"), _answers(nation, "google", "n_nationkey", volume, '{"items":[', "]}")]
    return made[0].union(made[1]).union(made[2]).union(made[3])


_OK = f"({{k}} // 10) % {_GONE} <> 5 AND ({{k}} // 10) % {_CUT} <> 3"


@query(f"""SELECT 'ol:/works/' || p_partkey AS id, 'openlibrary' AS source, p_name AS title, p_brand || ', Anon' AS author, 1900 + p_size AS year, p_type || '|Goods' AS subjects, CAST(NULL AS BIGINT) AS downloads, p_size % 2 = 0 AS full_text FROM part WHERE {_OK.format(k='p_partkey')}
UNION ALL SELECT 'ia:' || s_name, 'archive', CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Title' END, CASE WHEN s_suppkey % 2 = 0 THEN 'One' ELSE 'One, Two' END, CASE WHEN s_suppkey % 2 = 0 THEN 1999 END, CASE WHEN s_suppkey % 2 = 0 THEN 'a|b' ELSE 'a|b|c' END, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE s_suppkey END, true FROM supplier WHERE {_OK.format(k='s_suppkey')}
UNION ALL SELECT 'pg:' || c_custkey, 'gutenberg', c_name, c_mktsegment, NULL, c_mktsegment, c_custkey, true FROM customer WHERE {_OK.format(k='c_custkey')}
UNION ALL SELECT 'gb:' || n_nationkey, 'google', n_name || CASE WHEN n_nationkey % 2 = 0 THEN ': II' ELSE '' END, '', 1950, '', NULL, n_regionkey = 1 FROM nation WHERE {_OK.format(k='n_nationkey')}""")
def catalog_records(spark, sf_dir):
    """Four kinds of answers as one kind of row; broken and missing answers cost themselves alone."""
    rows = S.records(_all(spark, sf_dir))
    return rows.select("id", "source", "title", "author", "year", F.array_join("subjects", "|").alias("subjects"), "downloads", "full_text")


@query(" UNION ALL ".join(f"SELECT DISTINCT '{s}' AS source, CAST({k} // 10 AS BIGINT) AS answer, CASE WHEN ({k} // 10) % {_GONE} = 5 THEN 'no answer' ELSE 'not JSON of this catalogue' END AS error FROM {t} WHERE NOT ({_OK.format(k=k)})" for s, t, k in (("openlibrary", "part", "p_partkey"), ("archive", "supplier", "s_suppkey"), ("gutenberg", "customer", "c_custkey"), ("google", "nation", "n_nationkey"))))
def catalog_errors(spark, sf_dir):
    return S.errors(_all(spark, sf_dir))


@query("""SELECT l_orderkey AS item, 'f' || l_linenumber || '.txt' AS name, l_returnflag AS format, CAST(l_quantity AS BIGINT) AS size, CASE WHEN l_orderkey % 3 = 0 THEN 'json' ELSE 'xml' END AS how FROM lineitem WHERE l_orderkey % 3 < 2
UNION ALL SELECT DISTINCT l_orderkey, NULL, '', 0, 'error' FROM lineitem WHERE l_orderkey % 3 = 2""")
def item_files(spark, sf_dir):
    """File lists of items (orders): a third as JSON, a third as XML beside empty JSON, a third as neither."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("f"), "l_linenumber", F.lit(".txt")).alias("name"), F.col("l_returnflag").alias("format"), F.col("l_quantity").cast("long").cast("string").alias("size"))
    files = F.array_sort(F.collect_list(F.struct("l_linenumber", "name", "format", "size")))
    rows = lines.groupBy(F.col("l_orderkey").alias("item")).agg(files.alias("files"))
    json = F.concat(F.lit('{"files":'), F.to_json(F.transform("files", lambda f: F.struct(f["name"].alias("name"), f["format"].alias("format"), f["size"].alias("size")))), F.lit("}"))
    xml = F.concat(F.lit("<files>"), F.array_join(F.transform("files", lambda f: F.concat(F.lit('<file name="'), f["name"], F.lit('"><format>'), f["format"], F.lit("</format><size>"), f["size"], F.lit("</size></file>"))), ""), F.lit("</files>"))
    kind = F.col("item") % 3
    return S.item_files(rows.select("item", F.when(kind == 0, json).when(kind == 1, '{"files":[]}').otherwise("refused").alias("metadata"), F.when(kind == 1, xml).otherwise("").alias("files_xml")))
