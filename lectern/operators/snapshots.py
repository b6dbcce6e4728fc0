"""A store of several tables whose changes are one: every commit names a version of each table, and readers see whole commits only."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import upsert


class Store:
    """Tables under `root`, a folder that the driver and all executors share.

    A commit writes the tables that change to folders of their own, then a small file with the next number that names the folder of every
    table. Whoever opens the store reads the file with the highest number. A writer that fails before that leaves folders that nothing names,
    and the version before stays as it is; of two writers of one number the second fails (FileExistsError) and has changed nothing.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def version(self) -> int:
        """The last commit; 0 before the first."""
        return max((n for n, _ in self._commits()), default=0)

    def _commits(self) -> list[tuple[int, str]]:
        fs, folder = self._at(f"{self.root}/commits")
        found = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return [(int(name.split(".")[0]), name) for name in found if name.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict[str, dict]:
        """table: {path, schema} of a version, the last one unless told."""
        version = self.version() if version is None else version
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/commits/{version:012}.json", wholetext=True).first()[0])

    def table(self, name: str, version: int | None = None) -> DataFrame:
        entry = self.manifest(version)[name]
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(entry["path"])

    def commit(self, changes: dict[str, DataFrame], drop: tuple[str, ...] = ()) -> int:
        """The number of the new version, in which `changes` replace tables of their names and those in `drop` are gone."""
        base = self.version()
        names = {k: v for k, v in self.manifest(base).items() if k not in drop}
        for name, df in changes.items():
            path = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            names[name] = {"path": path, "schema": json.loads(df.schema.json())}
        # Written aside and renamed: no reader meets half a file.
        fs, aside = self._at(f"{self.root}/commits/{uuid.uuid4().hex}.tmp")
        _, to = self._at(f"{self.root}/commits/{base + 1:012}.json")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(names).encode()))
        out.close()
        if fs.exists(to) or not fs.rename(aside, to):
            fs.delete(aside, False)
            raise FileExistsError(f"version {base + 1} is there already; open the store again")
        return base + 1

    def save(self, **tables: tuple[DataFrame, list[str]]) -> int:
        """Upserts rows (with distinct keys) into several tables, which begin empty, in one commit: save(books=(rows, ["book_id"]), …)."""
        there = self.manifest()
        return self.commit({name: upsert(self.table(name), rows, keys).select(*self.table(name).columns) if name in there else rows for name, (rows, keys) in tables.items()})

    def delete_where(self, name: str, gone: Column) -> int:
        """Deletes the rows where the condition holds (not where it is null) and returns their number. None: no new version."""
        rows = self.table(name)
        hit = F.coalesce(gone, F.lit(False))
        count = rows.filter(hit).count()
        if count:
            self.commit({name: rows.filter(~hit)})
        return count

    def delete(self, name: str, keys: DataFrame) -> int:
        """Deletes the rows whose values in the columns of `keys` are there; returns their number."""
        rows, by = self.table(name), keys.columns
        count = rows.join(keys.distinct(), by, "left_semi").count()
        if count:
            self.commit({name: rows.join(keys.distinct(), by, "left_anti").select(*rows.columns)})
        return count

    def clear(self, *names: str) -> int:
        """Empties tables, in one commit; they keep their columns."""
        return self.commit({name: self.table(name).limit(0) for name in names})

    def wipe(self) -> int:
        """Empties every table, settings included, in one commit."""
        return self.clear(*self.manifest())


def save_books(store: Store, books: DataFrame, content: DataFrame) -> int:
    """Books, their content and progress at nothing, in one commit. books has book_id; content book_id, c and p.

    Saving a book again replaces it, and its progress begins anew; paragraphs that the new content lacks are gone.
    """
    ids = books.select("book_id").distinct()
    progress = ids.select("book_id", F.lit(0.0).alias("percent"), F.lit(0).alias("c"), F.lit(0).alias("p"))
    if "content" not in store.manifest():
        return store.commit({"books": books, "content": content, "progress": progress})
    old = {name: store.table(name).join(ids, "book_id", "left_anti") for name in ("books", "content", "progress")}
    new = {"books": books, "content": content, "progress": progress}
    return store.commit({name: old[name].unionByName(new[name], allowMissingColumns=True) for name in new})


def appended(content: DataFrame, more: DataFrame) -> DataFrame:
    """content (book_id, c, p, text) with the paragraphs `more` (book_id, k, text) at the end of each book's last chapter, in the order of k.

    Books that content does not have get a first chapter of them.
    """
    last = content.groupBy("book_id").agg(F.max(F.struct("c", "p")).alias("last"))
    nth = F.row_number().over(Window.partitionBy("book_id").orderBy("k")) - 1
    numbered = more.select("book_id", "k", "text").withColumn("nth", nth).join(last, "book_id", "left")
    at = F.coalesce(F.col("last.p") + 1, F.lit(0)) + F.col("nth")
    kinds = dict(content.dtypes)
    new = numbered.select("book_id", F.coalesce("last.c", F.lit(0)).cast(kinds["c"]).alias("c"), at.cast(kinds["p"]).alias("p"), "text")
    return content.select("book_id", "c", "p", "text").unionByName(new)


def recounted(books: DataFrame, content: DataFrame) -> DataFrame:
    """books with chapters, paragraphs and words as content has them now."""
    words = F.regexp_count("text", F.lit(r"\S+"))
    counts = content.groupBy("book_id").agg(F.count_distinct("c").alias("chapters"), F.count("*").alias("paragraphs"), F.sum(words).cast("long").alias("words"))
    rest = [c for c in books.columns if c not in ("chapters", "paragraphs", "words")]
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("chapters", "paragraphs", "words")]
    return books.select(*rest).join(counts, "book_id", "left").select(*rest, *zero)
