"""Streams over the event table; each gives what the batch query gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.shared import fresh_folder
from ..registry import ORACLE_SQL, query
from ..streaming import sessions as R
from . import reading  # noqa: F401  its SQL is the twin


@query(ORACLE_SQL["sessionize"])
def stream_sessions(spark, sf_dir):
    # A pattern, since a stream takes no single file.
    rows = R.run_sessions(spark, f"{sf_dir}/events.parque[t]", fresh_folder(spark, "sessions"))
    return rows.select("book_id", "nth", "mode", "start", "end", "ms", "words", "events")


@query(f"{ORACLE_SQL['session_positions'].rpartition('SELECT *')[0]}SELECT a.book_id, a.nth, g_start, g_end, page_start, page_end FROM a JOIN sess USING (book_id, nth)")
def stream_positions(spark, sf_dir):
    """Where the sessions of the stream begin and end."""
    rows = R.run_sessions(spark, f"{sf_dir}/events.parque[t]", fresh_folder(spark, "positions"))
    return rows.select("book_id", "nth", "g_start", "g_end", "page_start", "page_end")


@query("""SELECT user_id AS book_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id, round(arg_max(least(1.0, coalesce(value, 0) / 200), {'t': ts, 'e': event_id}), 9) AS percent,
min(epoch_us(ts)) FILTER (least(1.0, coalesce(value, 0) / 200) >= 0.985) AS finished_us FROM events GROUP BY user_id""")
def stream_progress(spark, sf_dir):
    rows = R.run_progress(spark, f"{sf_dir}/events.parque[t]", fresh_folder(spark, "progress"))
    return rows.select("book_id", "event_id", F.round("percent", 9).alias("percent"), "finished_us")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS events, CAST(sum(floor(coalesce(value, 0))) AS BIGINT) AS words FROM events GROUP BY ALL")
def stream_daily(spark, sf_dir):
    rows = R.run_daily(spark, f"{sf_dir}/events.parque[t]", fresh_folder(spark, "daily"))
    return rows.withColumn("day", F.col("day").cast("string"))
