"""Streams over many files in any order give what the batch queries give."""

import glob
import os
import random

from pyspark.sql import functions as F

from lectern.operators import sessions as S
from lectern.streaming import sessions as R

EVENTS = "/root/testdata/sf0.001/events.parquet"
COLUMNS = ["book_id", "nth", "mode", "start", "end", "ms", "words", "events"]


def shuffled(spark, to, files):
    """The events in files of random rows, which arrive in a random order."""
    spark.read.parquet(EVENTS).withColumn("r", F.rand(5)).repartitionByRange(files, "r").drop("r").write.parquet(f"{to}/all")
    os.makedirs(f"{to}/in")
    parts = sorted(glob.glob(f"{to}/all/*.parquet"))
    random.Random(3).shuffle(parts)
    for k, part in enumerate(parts):
        os.rename(part, f"{to}/in/{k:03}.parquet")
    return f"{to}/in"


def rows(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_shuffled_files(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    got = R.run_sessions(spark, shuffled(spark, tmp_path, 100), f"{tmp_path}/out", files_per_batch=24)
    want = S.sessions(S.activity(events))
    assert rows(got, COLUMNS) == rows(want, COLUMNS)
    at = ["book_id", "nth", "g_start", "g_end", "page_start", "page_end"]
    assert rows(got.fillna(-1, at), at) == rows(S.session_positions(S.moves(events)).fillna(-1, at).join(want.select("book_id", "nth"), ["book_id", "nth"]), at)


def test_settled_in_order(spark, tmp_path):
    """Files in the order of time: with an hour for late events nearly all sessions are settled, and a second call goes on."""
    events = spark.read.parquet(EVENTS)
    os.makedirs(f"{tmp_path}/in")
    parts = events.repartitionByRange(6, "ts").sortWithinPartitions("ts")
    parts.write.parquet(f"{tmp_path}/all")
    files = sorted(glob.glob(f"{tmp_path}/all/*.parquet"))
    for k, f in enumerate(files):
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))  # a stream takes older files first
    for half in (files[:3], files[3:]):
        for f in half:
            os.rename(f, f"{tmp_path}/in/{os.path.basename(f)}")
        got = R.run_sessions(spark, f"{tmp_path}/in", f"{tmp_path}/out", late_s=3600, files_per_batch=1)
    want = S.sessions(S.activity(events))
    assert rows(got, COLUMNS) == rows(want, COLUMNS)
    assert spark.read.parquet(f"{tmp_path}/out/rows").filter("settled").count() > 0.8 * want.count()


def test_fold():
    """Overtaken events count at the session's last moment; positions skip what is not known."""
    now, closed = R.fold(R.Session(), [(10, 1, "read", 5, None, None), (200, 2, "read", 5, 7, None), (300, 3, "listen", 1, 9, 4)], 100)
    assert closed == [(1, "read", 10, 200, 200, 10, 2, 7, 7, None, None, False)]
    now, closed = R.fold(now, [(50, 0, "listen", 1, None, 6)], 100)
    assert closed == [] and now == R.Session(2, "listen", 300, 300, 0, 2, 2, 9, 9, 4, 6)
