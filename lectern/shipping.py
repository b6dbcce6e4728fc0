"""Sends the package to executors, wherever a job starts from."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark import SparkFiles
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def _beside(spark: SparkSession) -> bool:
    """Whether workers run on this machine and find the package by themselves. Of other machines the driver's paths say nothing."""
    if not spark.sparkContext.master.startswith("local"):
        return False
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    here = os.path.realpath(os.getcwd()) == os.path.realpath(ROOT) and spark.sparkContext.master.startswith("local[")
    return here or os.path.realpath(ROOT) in {os.path.realpath(p) for p in paths if p}


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for an application; Spark serves the archive from the driver."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or _beside(spark):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(os.path.join(ROOT, "lectern")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, ROOT))
        for name in ("corpus_pipeline.py", "__spark_entry__.py"):
            if os.path.exists(os.path.join(ROOT, name)):
                archive.write(os.path.join(ROOT, name), name)
    # Spark's own folder on the driver, which serves it to executors as long as the application lives and is deleted with it.
    path = os.path.join(SparkFiles.getRootDirectory(), "shipped", f"lectern-{app}.zip")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as file:
        file.write(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
