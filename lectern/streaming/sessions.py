"""The streaming twin of operators.sessions: sessions, latest progress and daily counts from an activity stream."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import IDLE_S, MIN_MS, MIN_WORDS, micros, moves
from ..operators.store import latest

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: How far behind its book's newest event an event may come and still take its place in order.
LATE_S = 30 * 86_400
_ROW = "book_id long, version long, settled boolean, nth long, mode string, start_us long, end_us long, active_us long, words long, events long, g_start long, g_end long, page_start long, page_end long, open boolean"
_HELD = ("us", "event_id", "mode", "words", "g", "page")
_STATE = "version long, nth long, mode string, start_us long, last_us long, active_us long, words long, events long, g_start long, g_end long, page_start long, page_end long, " + ", ".join(
    f"held_{c} array<{'string' if c == 'mode' else 'long'}>" for c in _HELD
)


def read_events(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Event files as they arrive. The schema is fixed: a stream must not guess it."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class Session(NamedTuple):
    """The session that a book is in. nth is 0 before its first event."""

    nth: int = 0
    mode: str | None = None
    start: int = 0
    last: int = 0
    active: int = 0
    words: int = 0
    events: int = 0
    g_start: int | None = None
    g_end: int | None = None
    page_start: int | None = None
    page_end: int | None = None

    def row(self, open_: bool) -> tuple:
        return (self.nth, self.mode, self.start, self.last, self.active, self.words, self.events, self.g_start, self.g_end, self.page_start, self.page_end, open_)


def fold(now: Session, events: Iterable[tuple], cap: int) -> tuple[Session, list[tuple]]:
    """The session machine of one reader: begin or continue, touch, move, switch, end. events are in order; also the sessions that end.

    A session's first known position is its start, its last known one its end.
    """
    closed = []
    for us, _, mode, words, g, page in events:
        us = max(us, now.last) if now.nth else us
        if now.nth:
            now = now._replace(active=now.active + min(cap, us - now.last))
        if not now.nth or mode != now.mode:
            if now.nth:
                closed.append(now.row(False))
            now = Session(now.nth + 1, mode, us)
        first = {k: v for k, v in (("g_start", g), ("page_start", page)) if getattr(now, k) is None}
        last = {k: v for k, v in (("g_end", g), ("page_end", page)) if v is not None}
        now = now._replace(last=us, words=now.words + words, events=now.events + 1, **first, **last)
    return now, closed


def track(idle_s: int = IDLE_S, late_s: int = LATE_S):
    """Sessions of a book from events that come in any order.

    State is the session at the frontier, which lies late_s behind the newest event, and the events since, in order. Events up to the
    frontier are settled: the sessions that they end are written once. What lies beyond is worked out anew with each batch and written
    as unsettled, like a heartbeat; of those rows the latest version counts. Events that the frontier has overtaken count at its moment.
    """
    cap = idle_s * 1_000_000

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, now, held = 0, Session(), []
        if state.exists:
            version, *rest = state.get
            now, held = Session(*rest[:11]), list(zip(*rest[11:], strict=True))
        for rows in batches:
            held += [tuple(None if v is None or v != v else v for v in r) for r in zip(*(rows[c].astype(object).tolist() for c in _HELD), strict=True)]
        held = sorted((int(us), int(e), m, int(w), None if g is None else int(g), None if p is None else int(p)) for us, e, m, w, g, p in held) if held else []
        frontier = held[-1][0] - late_s * 1_000_000 if held else 0
        cut = bisect_right(held, frontier, key=lambda e: e[0])
        now, closed = fold(now, held[:cut], cap)
        held = held[cut:]
        ahead, unsettled = fold(now, held, cap)
        version += 1
        state.update((version, *now, *(list(c) for c in (zip(*held, strict=True) if held else [()] * len(_HELD)))))
        out = [(key[0], version, True, *r) for r in closed] + [(key[0], version, False, *r) for r in [*unsettled, ahead.row(True)]]
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _ROW.split(", ")])
        yield frame.astype({c: "Int64" for c in ("g_start", "g_end", "page_start", "page_end")})

    return run


def session_stream(events: DataFrame, idle_s: int = IDLE_S, late_s: int = LATE_S) -> DataFrame:
    rows = moves(events).select("book_id", "event_id", "us", F.coalesce("mode", F.lit("")).alias("mode"), "words", "g", "page")
    return rows.groupBy("book_id").applyInPandasWithState(track(idle_s, late_s), _ROW, _STATE, "append", GroupStateTimeout.NoTimeout)


def sessions_so_far(written: DataFrame) -> DataFrame:
    """The sessions of all events so far, after the rule that drops tiny ones; what a crash left open is closed as it stands."""
    newest = written.groupBy("book_id").agg(F.max("version").alias("newest"))
    last = written.join(newest, "book_id").filter("settled OR version = newest")
    ms = F.floor(F.col("active_us") / 1000)
    at = lambda c: F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col(c) / F.lit(1_000_000).cast("decimal(18,6)"))
    rows = last.select("book_id", "nth", "mode", at("start_us").alias("start"), at("end_us").alias("end"), ms.alias("ms"), F.greatest(F.lit(0), "words").alias("words"), "events", "g_start", "g_end", "page_start", "page_end")
    return rows.filter((F.col("ms") >= MIN_MS) | (F.col("words") >= MIN_WORDS))


def run_sessions(spark: SparkSession, events_path: str, to: str, idle_s: int = IDLE_S, late_s: int = LATE_S, files_per_batch: int = 64) -> DataFrame:
    """Works off all event files that are there and returns the sessions so far. A second call takes only new files."""
    query = session_stream(read_events(spark, events_path, files_per_batch), idle_s, late_s).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start(f"{to}/rows")
    query.awaitTermination()
    return sessions_so_far(spark.read.parquet(f"{to}/rows"))


def run_progress(spark: SparkSession, events_path: str, to: str, done: float = 0.985) -> DataFrame:
    """Latest value per book, kept by foreachBatch: each batch is merged into the table's next version, so a repeated batch changes nothing.

    finished_us is set once, by the first event at or over `done`, and stays.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        percent = F.least(F.lit(1.0), F.coalesce("value", F.lit(0.0)) / 200)
        new = batch.select(F.col("user_id").alias("book_id"), micros(F.col("ts")).alias("us"), "event_id", percent.alias("percent"))
        finished = new.groupBy("book_id").agg(F.min(F.when(F.col("percent") >= done, F.col("us"))).alias("finished_us"))
        now = latest(new, ["book_id"], ["us", "event_id"]).join(finished, "book_id")
        if batch_id:
            old = session.read.parquet(f"{to}/v{batch_id - 1}")
            first = old.select("book_id", "finished_us").union(now.select("book_id", "finished_us")).groupBy("book_id").agg(F.min("finished_us").alias("finished_us"))
            now = latest(old.drop("finished_us").unionByName(now.drop("finished_us")), ["book_id"], ["us", "event_id"]).join(first, "book_id")
        now.write.mode("overwrite").parquet(f"{to}/v{batch_id}")
        session.createDataFrame([(batch_id,)], "version long").write.mode("append").parquet(f"{to}/versions")

    query = read_events(spark, events_path).writeStream.foreachBatch(merge).option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    version = spark.read.parquet(f"{to}/versions").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{to}/v{version}")


def daily_stream(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events and words by day, with a watermark: state of days that are over goes once they cannot change."""
    at = F.timestamp_micros(micros(F.col("ts")))
    rows = events.withColumn("at", at).withWatermark("at", late)
    counts = rows.groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("events"), F.sum(F.floor(F.coalesce("value", F.lit(0.0)))).alias("words"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros("window.start") / 86_400_000_000).cast("int"))
    return counts.select(day.alias("day"), "event_type", "events", "words")


def run_daily(spark: SparkSession, events_path: str, to: str) -> DataFrame:
    """Each batch's changed days are written in update mode; the last write of a day counts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{to}/rows/batch={batch_id}x")

    query = daily_stream(read_events(spark, events_path)).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(*[f"{to}/rows/*"])
    return latest(rows, ["day", "event_type"], ["batch"]).drop("batch")
