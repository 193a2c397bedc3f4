"""Event-time operators, the same on tables and streams: windows, sessions, dedup, joins in time and silence.

Records carry event_time_ms. On a stream, delay_ms is how far behind the newest a record may come: later ones are
dropped by Spark, which counts them, and results come once their time has passed. On a table nothing is late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import previous
from ..operators.records import aggregate_input

_QUIET = "source string, key string, last_ms long, quiet_ms long"


def timed(df: DataFrame, delay_ms: int = 0, name: str = "at") -> DataFrame:
    """With the event time as a timestamp and, on a stream, its watermark."""
    if delay_ms < 0:
        raise ValueError("delay_ms must not be negative")
    out = df.withColumn(name, F.timestamp_millis("event_time_ms"))
    return out.withWatermark(name, f"{delay_ms} milliseconds") if df.isStreaming else out


def _figures(function: str) -> Column:
    return F.count("x").cast("double") if function == "count" else getattr(F, function)("x")


def _spans(df: DataFrame, window: Column, function: str) -> DataFrame:
    out = df.groupBy("source", "key", window.alias("w")).agg(_figures(function).alias("value"), F.count("x").alias("count"))
    return out.select("source", "key", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "value", "count")


def window_aggregate(df: DataFrame, function: str, path: str | None, width_ms: int, slide_ms: int | None = None, delay_ms: int = 0) -> DataFrame:
    """Tumbling windows aligned to the epoch, or sliding ones: a row for each key and window that holds a record."""
    if width_ms < 1 or slide_ms is not None and not 0 < slide_ms <= width_ms:
        raise ValueError("a window needs a positive width and a slide up to it")
    x = timed(aggregate_input(df, function, path), delay_ms)
    return _spans(x, F.window("at", f"{width_ms} milliseconds", f"{slide_ms or width_ms} milliseconds"), function)


def session_aggregate(df: DataFrame, function: str, path: str | None, gap_ms: int, delay_ms: int = 0) -> DataFrame:
    """Sessions of a key: runs of records less than the gap apart; one ends the gap behind its last record."""
    if gap_ms < 1:
        raise ValueError("a session needs a positive gap")
    x = timed(aggregate_input(df, function, path), delay_ms)
    return _spans(x, F.session_window("at", f"{gap_ms} milliseconds"), function)


def dedup(df: DataFrame, columns: list[str], delay_ms: int = 0) -> DataFrame:
    """The first of the records that agree in the columns: by (ts_ms, seq) of a table, by arrival within the delay of a
    stream, whose state the delay bounds."""
    if df.isStreaming:
        return timed(df, delay_ms).dropDuplicatesWithinWatermark(columns).drop("at")
    rest = [c for c in df.columns if c not in columns]
    first = df.groupBy(*columns).agg(F.min_by(F.struct(*rest), F.struct("ts_ms", "seq")).alias("_first"))
    return first.select(*columns, "_first.*").select(*df.columns)


def join_within(left: DataFrame, right: DataFrame, within_ms: int, delay_ms: int = 0, width_ms: int | None = None) -> DataFrame:
    """Pairs of records of one key at most so far apart in event time: key, left_* and right_* columns.

    Keys are joined within slots of time, so a hot key is spread over its slots: a right record goes to the slots that
    its reach touches. On streams the time range bounds what is held.
    """
    if within_ms < 0:
        raise ValueError("within_ms must not be negative")
    width = max(1, within_ms if width_ms is None else width_ms)
    cols = ("value", "event_time_ms", "ts_ms", "seq")
    a = timed(left, delay_ms, "left_at").select("key", "left_at", *[F.col(c).alias(f"left_{c}") for c in cols])
    b = timed(right, delay_ms, "right_at").select(F.col("key").alias("right_key"), "right_at", *[F.col(c).alias(f"right_{c}") for c in cols])
    slot = lambda c: F.floor(c / F.lit(width)).cast("long")
    a = a.withColumn("slot", slot(F.col("left_event_time_ms")))
    b = b.withColumn("right_slot", F.explode(F.sequence(slot(F.col("right_event_time_ms") - within_ms), slot(F.col("right_event_time_ms") + within_ms))))
    near = (F.col("left_at") >= F.col("right_at") - F.expr(f"make_dt_interval(0, 0, 0, {within_ms / 1000})")) & (F.col("left_at") <= F.col("right_at") + F.expr(f"make_dt_interval(0, 0, 0, {within_ms / 1000})"))
    same = (F.col("key") == F.col("right_key")) & (F.col("slot") == F.col("right_slot")) & near
    return a.join(b, same).drop("right_key", "slot", "right_slot", "left_at", "right_at")


def quiet_keys(df: DataFrame, silence_ms: int, until_ms: int) -> DataFrame:
    """Of a table, each silence of a key of at least so long: from its record at last_ms until the next one or until_ms."""
    rows = df.select("source", "key", "event_time_ms", "seq")
    seen = previous(rows, ["source", "key"], ["event_time_ms", "seq"], {"before": "event_time_ms"})
    between = seen.where(F.col("event_time_ms") - F.col("before") >= silence_ms).select("source", "key", F.col("before").alias("last_ms"), (F.col("event_time_ms") - F.col("before")).alias("quiet_ms"))
    last = rows.groupBy("source", "key").agg(F.max("event_time_ms").alias("last_ms"))
    open_ = last.where(F.lit(until_ms) - F.col("last_ms") >= silence_ms).select("source", "key", "last_ms", (F.lit(until_ms) - F.col("last_ms")).alias("quiet_ms"))
    return between.unionByName(open_)


def watch_silence(df: DataFrame, silence_ms: int, delay_ms: int = 0) -> DataFrame:
    """Of a stream, a row for each key once its time passes its last record by the silence; quiet_ms is the silence."""

    def of(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, last, silence_ms)], columns=["source", "key", "last_ms", "quiet_ms"])
            return
        newest = max(int(p["event_time_ms"].max()) for p in pdfs)
        last = newest if last is None else max(last, newest)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + silence_ms, state.getCurrentWatermarkMs() + 1))

    rows = timed(df, delay_ms).select("source", "key", "event_time_ms", "at")
    return rows.groupBy("source", "key").applyInPandasWithState(of, _QUIET, "last long", "append", GroupStateTimeout.EventTimeTimeout)
