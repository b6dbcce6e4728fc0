"""The store of versions: whole commits, and nothing of a writer that fails."""

import pytest
from pyspark.sql import functions as F

from lectern.operators.snapshots import Store, appended, recounted, save_books


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def library(spark, ids):
    return spark.createDataFrame([(k, f"b{k}") for k in ids], "book_id int, title string"), spark.createDataFrame([(k, c, p, f"text {k} {c} {p}") for k in ids for c in range(2) for p in range(k)], "book_id int, c int, p int, text string")


def test_save_and_replace(spark, store):
    assert store.version() == 0 and store.manifest() == {}
    assert save_books(store, *library(spark, [1, 2])) == 1
    store.commit({"progress": store.table("progress").withColumn("percent", F.lit(0.5))})
    books, content = library(spark, [2, 3])
    save_books(store, books.withColumn("title", F.lit("new")), content.filter("c = 0"))
    assert rows(store.table("books")) == [(1, "b1"), (2, "new"), (3, "new")]
    assert rows(store.table("progress").select("book_id", "percent")) == [(1, 0.5), (2, 0.0), (3, 0.0)]
    assert rows(store.table("content").groupBy("book_id").count()) == [(1, 2), (2, 2), (3, 3)]
    assert rows(store.table("books", 1)) == [(1, "b1"), (2, "b2")]
    store.save(books=(spark.createDataFrame([(1, "again"), (9, "b9")], "book_id int, title string"), ["book_id"]), settings=(spark.createDataFrame([("a", "b")], "key string, value string"), ["key"]))
    assert rows(store.table("books"))[0] == (1, "again") and store.table("settings").count() == 1


def test_deletes(spark, store):
    save_books(store, *library(spark, [1, 2, 3]))
    assert store.delete_where("content", F.col("c") == 1) == 6 and store.table("content").count() == 6
    assert store.delete_where("content", F.lit(None).cast("boolean")) == 0
    before = store.version()
    assert store.delete("books", spark.createDataFrame([(7,)], "book_id int")) == 0 and store.version() == before
    assert store.delete("books", spark.createDataFrame([(1,), (1,), (3,)], "book_id int")) == 2
    store.clear("content")
    assert store.table("content").count() == 0 and store.table("content").columns == ["book_id", "c", "p", "text"] and store.table("books").count() == 1
    store.wipe()
    assert [store.table(n).count() for n in ("books", "content", "progress")] == [0, 0, 0]


def test_failed_writers(spark, store):
    save_books(store, *library(spark, [1, 2]))
    broken = store.table("content").withColumn("text", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.commit({"books": store.table("books").limit(0), "content": broken})
    assert store.version() == 1 and store.table("books").count() == 2 and store.table("content").count() == 6

    class Late(Store):
        """Another writer commits while this one works."""

        def manifest(self, version=None):
            found = super().manifest(version)
            if not self.met:
                self.met = True
                Store(self.spark, self.root).clear("progress")
            return found

    late = Late(spark, store.root)
    late.met = False
    with pytest.raises(FileExistsError):
        late.commit({"books": store.table("books").limit(0)})
    assert store.version() == 2 and store.table("books").count() == 2 and store.table("progress").count() == 0


def test_append(spark):
    books, content = library(spark, [1, 2])
    more = spark.createDataFrame([(1, 5, "x y"), (1, 2, "first"), (4, 0, "new book")], "book_id int, k int, text string")
    got = appended(content, more)
    assert rows(got.filter("book_id != 2 and (c = 1 or book_id = 4)")) == [(1, 1, 0, "text 1 1 0"), (1, 1, 1, "first"), (1, 1, 2, "x y"), (4, 0, 0, "new book")]
    assert rows(recounted(books.withColumn("words", F.lit(7)), got)) == [(1, "b1", 2, 4, 11), (2, "b2", 2, 4, 16)]
