"""Reading sessions from activity events, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_round

IDLE_S, MIN_MS, MIN_WORDS = 120, 20_000, 30
#: What kinds of events stand for a mode of reading.
MODES = {"view": "read", "click": "listen", "purchase": "physical"}
SLOTS = ((0, "night owl"), (5, "early riser"), (8, "morning reader"), (12, "afternoon reader"), (17, "evening reader"), (21, "bedtime reader"))


def micros(ts: Column) -> Column:
    """Microseconds of a zone-less time."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def activity(events: DataFrame) -> DataFrame:
    """(book_id, event_id, ts, us, mode, words) from driver events."""
    mode = F.col("event_type")
    for kind, name in MODES.items():
        mode = F.when(F.col("event_type") == kind, name).otherwise(mode)
    return events.select(F.col("user_id").alias("book_id"), "event_id", "ts", micros(F.col("ts")).alias("us"), mode.alias("mode"), F.floor(F.coalesce("value", F.lit(0.0))).alias("words"))


def moves(events: DataFrame) -> DataFrame:
    """activity() with positions: g, the place in the text (k of the event's properties), and page, of physical reading."""
    page = F.when(F.col("event_type") == "purchase", F.floor("value"))
    where = events.select("event_id", F.col("user_id").alias("book_id"), micros(F.col("ts")).alias("us"), "event_type", "value", "ts", F.get_json_object("props", "$.k").cast("long").alias("g"), page.alias("page"))
    mode = F.col("event_type")
    for kind, name in MODES.items():
        mode = F.when(F.col("event_type") == kind, name).otherwise(mode)
    return where.select("book_id", "event_id", "ts", "us", mode.alias("mode"), F.floor(F.coalesce("value", F.lit(0.0))).alias("words"), F.when(F.col("event_type") != "signup", F.col("g")).alias("g"), "page")


def session_positions(rows: DataFrame) -> DataFrame:
    """Where each session began and ended: its first known position and its last, in text and in pages, and what lies between, 0 at least."""
    at = lambda c, f: f(F.when(F.col(c).isNotNull(), F.struct("us", "event_id", c)))[c]
    out = islands(rows).groupBy("book_id", "nth").agg(
        F.first("mode").alias("mode"), at("g", F.min).alias("g_start"), at("g", F.max).alias("g_end"), at("page", F.min).alias("page_start"), at("page", F.max).alias("page_end"),
    )
    between = lambda a, b: F.greatest(F.lit(0), F.coalesce(F.col(b) - F.col(a), F.lit(0)))
    return out.withColumns({"g_words": between("g_start", "g_end"), "pages": between("page_start", "page_end")})


def is_active(rows: DataFrame, now: Column, idle_s: int = IDLE_S) -> DataFrame:
    """(book_id, last_us, active): whether a book's last touch lies less than idle_s before now, in microseconds."""
    last = rows.groupBy("book_id").agg(F.max("us").alias("last_us"))
    return last.withColumn("active", now - F.col("last_us") < idle_s * 1_000_000)


def live(rows: DataFrame, now: Column, idle_s: int = 90) -> DataFrame:
    """Sessions that count at `now`: those that have ended, and an open one (the book's last) while its last event is less than idle_s old."""
    ends = islands(rows).groupBy("book_id", "nth").agg(F.max("us").alias("last_us"), F.count("*").alias("events"))
    open_ = F.col("nth") == F.max("nth").over(Window.partitionBy("book_id"))
    return ends.withColumn("open", open_).filter(~F.col("open") | (now - F.col("last_us") < idle_s * 1_000_000))


def islands(rows: DataFrame) -> DataFrame:
    """rows with nth, the number of the session: a new one begins whenever the mode changes."""
    w = Window.partitionBy("book_id").orderBy("us", "event_id")
    changed = F.when(F.lag("mode").over(w) == F.col("mode"), 0).otherwise(1)
    return rows.withColumn("changed", changed).withColumn("nth", F.sum("changed").over(w)).withColumn("next_us", F.lead("us").over(w)).drop("changed")


def sessions(rows: DataFrame, idle_s: int = IDLE_S) -> DataFrame:
    """One row per session. An idle stretch never ends a session, it only counts up to idle_s; the event that ends one still adds its gap.

    Sessions under 20 seconds with fewer than 30 words are dropped. One shuffle, by book.
    """
    gap = F.when(F.col("next_us").isNull(), 0).otherwise(F.least(F.lit(idle_s * 1_000_000), F.col("next_us") - F.col("us")))  # least() passes over nulls
    ms = F.floor(F.sum(gap) / 1000)
    out = islands(rows).groupBy("book_id", "nth").agg(F.first("mode").alias("mode"), F.min("ts").alias("start"), F.max("ts").alias("end"), ms.alias("ms"), F.greatest(F.lit(0), F.sum("words")).alias("words"), F.count("*").alias("events"))
    kept = out.filter((F.col("ms") >= MIN_MS) | (F.col("words") >= MIN_WORDS))
    return kept.withColumn("minutes", js_round(F.col("ms") / 6000) / 10).withColumn("day", F.to_date("start"))


def countable(s: DataFrame) -> Column:
    return (F.col("mode") == "read") & (F.col("words") > 30) & (F.col("minutes") >= 0.5)


def tenths(where: Column | None = None) -> Column:
    """Sum of minutes, exact: minutes are multiples of a tenth."""
    value = F.round(F.col("minutes") * 10).cast("long")
    return F.coalesce(F.sum(value if where is None else F.when(where, value)), F.lit(0)) / 10


def daily(s: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """The last `days` days, zero-filled: minutes, words, sessions, listened minutes."""
    sums = s.groupBy("day").agg(tenths().alias("minutes"), F.sum("words").alias("words"), F.count("*").alias("sessions"), tenths(F.col("mode") == "listen").alias("listen"))
    span = s.agg(today.alias("today")).select(F.explode(F.sequence(F.date_add("today", 1 - days), "today", F.expr("interval 1 day"))).alias("day"))
    zero = {"minutes": 0.0, "words": 0, "sessions": 0, "listen": 0.0}
    return span.join(sums, "day", "left").select("day", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in zero.items()])


def streaks(s: DataFrame, today: Column, by: list[str], least: float = 1.0) -> DataFrame:
    """Current run of active days (that of today or yesterday), best run, number of active days, and whether today is one."""
    now = s.groupBy(*by).agg(today.alias("today"))
    active = s.groupBy(*by, "day").agg(tenths().alias("m")).filter(F.col("m") >= least)
    run = F.date_sub("day", F.row_number().over(Window.partitionBy(*by).orderBy("day")))
    runs = active.withColumn("run", run).groupBy(*by, "run").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    rows = now.join(runs, by, "left")
    current = F.max(F.when(F.col("last") >= F.date_sub("today", 1), F.col("n")))
    return rows.groupBy(*by).agg(F.coalesce(current, F.lit(0)).alias("current"), F.coalesce(F.max("n"), F.lit(0)).alias("best"), F.coalesce(F.sum("n"), F.lit(0)).alias("active_days"), F.coalesce(F.bool_or(F.col("last") == F.col("today")), F.lit(False)).alias("today"))


def book_stats(s: DataFrame, by: list[str]) -> DataFrame:
    read = countable(s)
    r_min, r_words = tenths(read), F.sum(F.when(read, F.col("words")))
    return s.groupBy(*by).agg(
        tenths().alias("minutes"), F.count("*").alias("sessions"), F.sum("words").alias("words"), F.when(r_min >= 1, js_round(r_words / r_min)).alias("wpm"),
        tenths(F.col("mode") == "listen").alias("listen_minutes"), tenths(F.col("mode") == "physical").alias("physical_minutes"), F.max("end").alias("last_read"), F.min("start").alias("first_read"),
    )


def user_wpm(s: DataFrame) -> Column:
    read = countable(s)
    return F.when(tenths(read) >= 2, js_round(F.sum(F.when(read, F.col("words"))) / tenths(read)))


def slot(hour: Column) -> Column:
    out = F.lit(SLOTS[0][1])
    for first, name in SLOTS[1:]:
        out = F.when(hour >= first, name).otherwise(out)
    return out
