"""Where jobs put what all executors must see, and small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

_LOCAL: dict[str, str] = {}
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whole texts in a batch.
TEXTS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, as a URI. In local mode only, a fresh folder if that is unset.

    All operators come here, so the package is sent to executors on the way.
    """
    ship(spark)
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that no later step reads, as one round's state when the next is written."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str, batch_rows: int | None = None, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and lost executors cost no recomputation.

    path: where, if the caller wants to discard it later. batch_rows: rows of a batch between the JVM and Python while this is written. Batches of whole texts are kept small by it; both
    sides hold several at a time.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    before = spark.conf.get(BATCH_ROWS)
    if batch_rows:
        spark.conf.set(BATCH_ROWS, min(int(before), batch_rows) if int(before) > 0 else batch_rows)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if batch_rows:
            spark.conf.set(BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. lower() does just that on pure ASCII and is many times faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def as_text(text: Column) -> Column:
    """A text of which null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def spread(rows: DataFrame) -> DataFrame:
    """A partition for each row of a small table whose rows stand for much work, as a file does: adaptive execution keeps such partitions apart."""
    return rows.repartition(min(10_000, max(1, rows.count())))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows that lie in fewer splits than there are cores, dealt out: for work that takes far longer than reading does."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def boxed(columns: list[str], name: str = "row") -> Column:
    """The columns of a table as one struct, so that whatever they are called no inner name can meet them. See unboxed()."""
    return F.struct(F.lit(0).alias("z"), *[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(columns)]).alias(name)


def unboxed(columns: list[str], name: str = "row") -> list[Column]:
    return [F.col(f"{name}.c{k}").alias(c) for k, c in enumerate(columns)]
