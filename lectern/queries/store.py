"""The keyed store over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import snapshots as N
from ..operators import store as K
from ..plans.corpus import paragraphs
from ..plans.shared import fresh_folder
from ..registry import query, table
from . import sql


@query("SELECT o_custkey, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderkey, max(o_orderdate) AS o_orderdate, arg_max(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderstatus FROM orders GROUP BY o_custkey")
def upsert_latest(spark, sf_dir):
    """Each customer's last order, as the state after all orders were put in turn."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return K.latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(f"WITH {sql.PARAS}, gone AS (SELECT doc_id FROM labels WHERE toxic = 1), all_ AS (SELECT 'books' AS store, doc_id FROM documents UNION ALL SELECT 'content', doc_id FROM paras) SELECT store, count(*) AS rows_left FROM all_ WHERE doc_id NOT IN (SELECT doc_id FROM gone) GROUP BY store UNION ALL SELECT 'sessions', count(*) FROM events")
def cascade_delete(spark, sf_dir):
    """Toxic documents leave the books and content stores; activity stays."""
    docs = table(spark, sf_dir, "documents")
    tables = {"books": docs, "content": paragraphs(docs), "sessions": table(spark, sf_dir, "events").withColumnRenamed("user_id", "doc_id")}
    left = K.cascade_delete(tables, table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id")
    counts = [df.agg(F.count("*").alias("rows_left")).select(F.lit(name).alias("store"), "rows_left") for name, df in left.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query("SELECT user_id, count(*) AS events FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels) GROUP BY user_id")
def orphan_sessions(spark, sf_dir):
    """Activity whose book (a labelled document) is gone."""
    gone = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("user_id"))
    return table(spark, sf_dir, "events").join(gone, "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("events"))


@query("SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def backup_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    settings = spark.createDataFrame([("theme", "dark"), ("elevenKey", "s3cret")], "key string, value string")
    return K.restore(K.backup({"books": rows}, settings), {"books": rows.schema})["books"]


@query("WITH n AS (SELECT o_custkey AS k, count(*) AS c FROM orders GROUP BY 1) SELECT c_custkey, CASE WHEN c IS NOT NULL THEN 'orders:' || c ELSE c_name END AS c_name, c_acctbal FROM customer LEFT JOIN n ON k = c_custkey")
def patch_books(spark, sf_dir):
    changes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.concat(F.lit("orders:"), F.count("*").cast("string")).alias("c_name"))
    return K.patch(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), changes, ["c_custkey"])


@query(f"WITH {sql.PARAS} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY c, p) AS text FROM paras GROUP BY doc_id")
def text_export(spark, sf_dir):
    return K.text_export(paragraphs(table(spark, sf_dir, "documents")))


@query("""WITH l AS (SELECT l_suppkey AS id, l_partkey AS part, {'s': l_shipdate, 'k': l_orderkey, 'n': l_linenumber, 'q': l_quantity} AS v FROM lineitem), m AS (SELECT id, part, max(v) AS v FROM l GROUP BY ALL)
SELECT id, round(sum(least(CASE WHEN v.q > 40 THEN 50.0 ELSE v.q END, 50.0)) / sum(50.0), 9) AS percent FROM m GROUP BY id""")
def download_progress(spark, sf_dir):
    """Line items as download events: quantities are loaded of 50; over 40 counts as done."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("part"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity").alias("seq"), F.col("l_quantity").alias("loaded"), F.lit(50.0).alias("total"), (F.col("l_quantity") > 40).alias("done"))
    return K.contributions(rows).select("id", F.round("percent", 9).alias("percent"))


@query("WITH b AS (SELECT greatest(0, least(255, CAST(floor(value) AS BIGINT))) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1), r AS (SELECT bin, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS share FROM b) SELECT min(bin) FILTER (share >= 0.02) AS lo, min(bin) FILTER (share >= 0.98) AS hi FROM r")
def contrast_points(spark, sf_dir):
    return K.stretch_points(table(spark, sf_dir, "events"), "value")


@query("SELECT c.c_custkey, c.c_name, coalesce(count(o_orderkey), 0) AS started, coalesce(max(o_totalprice), 0.0) AS progress FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL")
def shelf_progress(spark, sf_dir):
    """Books with their progress, zero where there is none: the right side is aggregated before it is joined."""
    done = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("m"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("started"), F.coalesce("m", F.lit(0.0)).alias("progress"))


@query(f"SELECT p_partkey, p_name FROM part WHERE contains({sql.norm("p_name || ' ' || p_brand")}, {sql.norm("'RING Brand'")})")
def library_filter(spark, sf_dir):
    from ..functions.text import normalize

    return table(spark, sf_dir, "part").filter(F.contains(normalize(F.concat_ws(" ", "p_name", "p_brand")), normalize(F.lit("RING Brand")))).select("p_partkey", "p_name")


def _library(spark, sf_dir):
    """(books, content) of all documents."""
    docs = table(spark, sf_dir, "documents")
    content = paragraphs(docs).select(F.col("doc_id").alias("book_id"), "c", "p", "text")
    return docs.select(F.col("doc_id").alias("book_id"), "lang", "source"), content


def _turns(spark, sf_dir):
    """The turns of conversations as recognised pages of the books of their number."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("k"), "text")


@query(f"""WITH {sql.PARAS}, b AS (SELECT doc_id, lang, source FROM documents), gone AS (SELECT doc_id FROM labels WHERE toxic = 1), left_ AS (SELECT * FROM b WHERE lang IS DISTINCT FROM 'de'), kept AS (SELECT * FROM left_ WHERE doc_id NOT IN (SELECT doc_id FROM gone))
SELECT 1 AS step, 'books' AS store, count(*) AS n FROM b UNION ALL SELECT 1, 'content', count(*) FROM paras UNION ALL SELECT 1, 'progress', count(*) FROM b UNION ALL SELECT 1, 'settings', 1
UNION ALL SELECT 2, 'deleted', (SELECT count(*) FROM b WHERE lang = 'de') UNION ALL SELECT 2, 'books', count(*) FROM left_
UNION ALL SELECT 3, 'deleted', (SELECT count(*) FROM left_) - (SELECT count(*) FROM kept) UNION ALL SELECT 3, 'books', count(*) FROM kept
UNION ALL SELECT 4, 'books', count(*) FROM kept UNION ALL SELECT 4, 'content', 0 UNION ALL SELECT 4, 'progress', count(*) FROM b UNION ALL SELECT 4, 'settings', 1
UNION ALL SELECT 5, s, 0 FROM (VALUES ('books'), ('content'), ('progress'), ('settings')) t(s) UNION ALL SELECT 6, 'versions', 6""")
def store_lifecycle(spark, sf_dir):
    """Save, delete by a condition and by keys with counts, clear, wipe: rows of each table after each step, read by its version."""
    store = N.Store(spark, fresh_folder(spark, "store"))
    books, content = _library(spark, sf_dir)
    N.save_books(store, books, content)
    store.commit({"settings": spark.createDataFrame([("theme", "dark")], "key string, value string")})
    first, found = store.version(), []
    found.append((2, "deleted", store.delete_where("books", F.col("lang") == "de")))
    second = store.version()
    found.append((3, "deleted", store.delete("books", table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("book_id")))))
    third, fourth, fifth = store.version(), store.clear("content"), store.wipe()
    found.append((6, "versions", fifth))
    every = ("books", "content", "progress", "settings")
    rows = spark.createDataFrame(found, "step int, store string, n long")
    for step, version, names in ((1, first, every), (2, second, ("books",)), (3, third, ("books",)), (4, fourth, every), (5, fifth, every)):
        for name in names:
            rows = rows.union(store.table(name, version).agg(F.lit(step), F.lit(name), F.count("*")))
    return rows


@query(f"""WITH {sql.PARAS}, last AS (SELECT doc_id, max(c) AS c FROM paras GROUP BY doc_id), t AS (SELECT conv_id, text FROM conversations),
all_ AS (SELECT doc_id AS book_id, c, text FROM paras UNION ALL SELECT t.conv_id, coalesce(last.c, 0), t.text FROM t LEFT JOIN last ON last.doc_id = t.conv_id)
SELECT d.doc_id AS book_id, count(DISTINCT c) AS chapters, count(a.book_id) AS paragraphs, CAST(coalesce(sum(len(regexp_extract_all(a.text, '\\S+'))), 0) AS BIGINT) AS words FROM documents d LEFT JOIN all_ a ON a.book_id = d.doc_id GROUP BY d.doc_id""")
def append_pages(spark, sf_dir):
    """Books with recognised pages at the end of their last chapter, counted anew; books and content change in one commit."""
    store = N.Store(spark, fresh_folder(spark, "store"))
    books, content = _library(spark, sf_dir)
    N.save_books(store, books, content)
    more = N.appended(store.table("content"), _turns(spark, sf_dir))
    store.commit({"content": more, "books": N.recounted(store.table("books"), more)})
    return store.table("books").select("book_id", "chapters", "paragraphs", "words")
