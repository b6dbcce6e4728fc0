"""All queries over the package's own operators, by name, with their DuckDB twins."""

from __future__ import annotations

import importlib

from .shipping import ship

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, and the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str):
    """A table; texts that lie in fewer splits than there are cores are dealt out, since what is done with them is work for the CPU."""
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and rows.rdd.getNumPartitions() < cores:
        return rows.repartition(cores)
    return rows


#: Modules of lectern.queries.
PARTS = ("text", "positions", "matching", "reading", "markup", "library", "narration", "store", "streams", "formats", "choices", "timing", "pages", "voices", "catalogs")


def load() -> None:
    for part in PARTS:
        importlib.import_module(f"lectern.queries.{part}")
