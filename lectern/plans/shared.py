"""Folders that the driver and all executors see, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

_LOCAL: dict[str, str] = {}


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, in local mode only, under a temporary folder of the session."""
    ship(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='lectern-')}")
    return f"{base.rstrip('/')}/lectern/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what is read of it more than once is worked out once, and the same each time."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
