"""A keyed store of tables: upsert, delete, cascade, settings, backup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables that hold a book's data. Sessions outlive their book.
OWNED = ("books", "content", "progress", "calibration", "audio", "scans")
KINDS = ("books", "content", "progress", "sessions", "calibration")
MARK, VERSION = "lectern-backup", 1
#: Settings whose names look like this are secrets and never leave the store.
SECRET = "(?i)key|secret|token|password"
#: Settings longer than this are not mirrored.
MIRROR = 4000


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. One shuffle; aggregation sends one row per key and task."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; of new rows with one key any may count, so hand in distinct keys."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, ["_seq"]).drop("_seq")


def patch(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """A change replaces what it has a value for; keys that are not there are an error for the caller to look for (left_anti)."""
    named = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in changes.columns if c not in keys])
    joined = rows.join(named, keys, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in changes.columns and c not in keys else F.col(c) for c in rows.columns])


def delete_where(rows: DataFrame, gone: Column) -> DataFrame:
    return rows.filter(~F.coalesce(gone, F.lit(False)))


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, key: str = "book_id") -> dict[str, DataFrame]:
    """All owned tables without the rows of the given books; others as they are."""
    return {name: df.join(ids.select(key).distinct(), key, "left_anti").select(*df.columns) if name in OWNED else df for name, df in tables.items()}


def settings_export(settings: DataFrame) -> DataFrame:
    return settings.filter(~F.col("key").rlike(SECRET))


def settings_mirror(settings: DataFrame) -> DataFrame:
    return settings_export(settings).filter(F.length("value") < MIRROR)


def step_setting(current: Column, delta: Column, least: float, most: float) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(current, F.lit(0.0)) + delta))


def backup(tables: dict[str, DataFrame], settings: DataFrame) -> DataFrame:
    """(kind, mark, version, json): one row per stored row, so a backup is as distributed as the store."""
    out = settings_export(settings).select(F.lit("settings").alias("kind"), F.to_json(F.struct("key", "value")).alias("json"))
    for name, df in tables.items():
        out = out.union(df.select(F.lit(name).alias("kind"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json")))
    return out.select("kind", F.lit(MARK).alias("mark"), F.lit(VERSION).alias("version"), "json")


def restore(rows: DataFrame, schemas: dict, old: dict[str, DataFrame] | None = None, keys: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The tables of a backup by explicit schemas; with `old`, they are upserted into what is there. Rows without the mark are refused."""
    if not rows.filter((F.col("mark") != MARK) | F.col("mark").isNull() | (F.col("version") > VERSION)).isEmpty():
        raise ValueError("not a backup of this store")
    out = {}
    for name, schema in schemas.items():
        table = rows.filter(F.col("kind") == name).select(F.from_json("json", schema).alias("r")).select("r.*")
        out[name] = upsert(old[name], table, keys[name]) if old and keys else table
    return out


def save_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Writes a table of the store; sessions are best partitioned by day."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def get(spark: SparkSession, path: str, key: str, value: object) -> DataFrame:
    """A point read: the filter reaches the Parquet scan."""
    return spark.read.parquet(path).filter(F.col(key) == F.lit(value))


def text_export(paras: DataFrame) -> DataFrame:
    """(doc_id, text): chapters and paragraphs joined by blank lines; a book is one row because its export is one file."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("c", "p", "text"))), lambda t: t["text"])
    return paras.groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias("text"))


def contributions(parts: DataFrame) -> DataFrame:
    """(id, percent): several downloads as one: the latest state of each part, finished parts at their total."""
    last = latest(parts, ["id", "part"], ["seq"])
    loaded = F.least(F.when(F.col("done"), F.col("total")).otherwise(F.col("loaded")), F.col("total"))
    return last.groupBy("id").agg((F.sum(loaded) / F.sum("total")).alias("percent"))


def stretch_points(rows: DataFrame, value: str, low: float = 0.02, high: float = 0.98, bins: int = 256) -> DataFrame:
    """(lo, hi): bins at which the running share passes low and high: cut points for a contrast stretch."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(value))).alias("bin")).count()
    w = Window.orderBy("bin")  # at most `bins` rows
    run = counts.withColumn("share", F.sum("count").over(w) / F.sum("count").over(Window.partitionBy(F.lit(1))))
    return run.agg(F.min(F.when(F.col("share") >= low, F.col("bin"))).alias("lo"), F.min(F.when(F.col("share") >= high, F.col("bin"))).alias("hi"))
