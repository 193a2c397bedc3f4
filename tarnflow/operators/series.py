"""Pipe queries compiled to DataFrames. A series set has series_key, field, tags, ts_ns, pos, value."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_match
from ..plans.pipe_language import AGGREGATES, PipeQuery, Stage, TagFilter, parse
from .ordered import previous
from .points import guarded

DEFAULT_WINDOW_MS, MOST_BUCKETS = 60_000, 1_000_000
#: A server's limits (fixed values).
MOST_SCANNED, MOST_ANSWERED = 131_072, 4096
Source = Callable[[int | None, int | None], DataFrame]


def tag_predicate(f: TagFilter) -> Column:
    """An absent tag fails = and =~ and passes != and !~."""
    tag = F.element_at("tags", F.lit(f.name))
    hit = glob_match(tag, f.value) if f.op.endswith("~") else tag == f.value
    return F.coalesce(hit, F.lit(False)) if f.op in ("=", "=~") else tag.isNull() | ~hit


def scan(source: Source, query: PipeQuery, merged: bool) -> DataFrame:
    ns = lambda ms: None if ms is None else ms * 1_000_000
    df = source(ns(query.low_ms), ns(query.high_ms)).where((F.col("measurement") == query.measurement) & (F.col("field") == query.field))
    if query.low_ms is not None:
        df = df.where(F.col("ts_ns") >= ns(query.low_ms))
    if query.high_ms is not None:
        df = df.where(F.col("ts_ns") <= ns(query.high_ms))
    for f in query.filters:
        df = df.where(tag_predicate(f))
    if merged:
        key, tags = F.col("measurement"), F.create_map().cast("map<string,string>")
    else:
        key, tags = F.when(F.col("tag_key") == "", F.col("measurement")).otherwise(F.concat_ws(",", "measurement", "tag_key")), F.col("tags")
    return df.select(key.alias("series_key"), "field", tags.alias("tags"), "ts_ns", "pos", "value")


def _bucketed(df: DataFrame, width_ms: int, agg: Column) -> DataFrame:
    """Buckets from each series' earliest point; a grouped minimum keeps partial aggregation."""
    width = width_ms * 1_000_000
    origin = df.groupBy("series_key").agg(F.min("ts_ns").alias("origin"))
    i = F.expr(f"(ts_ns - origin) div {width}L")
    checked = F.when(i >= MOST_BUCKETS, F.raise_error(F.lit("too many buckets")).cast("long")).otherwise(i)
    out = df.join(origin, "series_key").withColumn("pos", checked).groupBy("series_key", "field", "origin", "pos").agg(agg.alias("value"), F.first("tags").alias("tags"))
    return out.select("series_key", "field", "tags", (F.col("origin") + F.col("pos") * F.lit(width)).alias("ts_ns"), "pos", F.col("value").cast("double").alias("value"))


def _previous(df: DataFrame) -> DataFrame:
    """With the value and time of the series' point before; a series' first point goes."""
    return previous(df, ["series_key"], ["ts_ns", "pos"], {"v0": "value", "t0": "ts_ns"}).where("t0 is not null")


def _edge(df: DataFrame, last: bool) -> DataFrame:
    pick = F.max_by if last else F.min_by
    got = df.groupBy("series_key").agg(pick(F.struct("field", "tags", "ts_ns", "pos", "value"), F.struct("ts_ns", "pos")).alias("p"))
    return got.select("series_key", "p.*").select("series_key", "field", "tags", "ts_ns", "pos", "value")


def ranking(df: DataFrame, k: int, top: bool = True) -> DataFrame:
    """series_key, score (the sum of its points) and rank from 1 of the first k series; ties keep the order of keys."""
    score = df.groupBy("series_key").agg(F.sum("value").alias("score"))
    order = [F.desc("score") if top else F.asc("score"), F.asc("series_key")]
    first = score.orderBy(*order).limit(k)  # k rows, so one task may number them
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _ranked(df: DataFrame, k: int, top: bool) -> DataFrame:
    """The points of the first k series."""
    return df.join(ranking(df, k, top).select("series_key"), "series_key", "left_semi")


def _math(op: str, n: float) -> Column:
    v = F.col("value")
    if op in "/%" and n == 0:
        return v
    return {"+": lambda: v + n, "-": lambda: v - n, "*": lambda: v * n, "/": lambda: v / n, "%": lambda: F.pmod(v, F.lit(n))}[op]()


def apply_stage(df: DataFrame, stage: Stage, width_ms: int, called: str | None = None) -> DataFrame:
    name, args = stage.name, stage.args
    if name in AGGREGATES:
        return _bucketed(df, width_ms, getattr(F, name)("value"))
    if name == "percentile":
        return _bucketed(df, width_ms, F.percentile("value", args[0] / 100))
    if name in ("first", "last"):
        return _edge(df, name == "last")
    if name == "delta":
        return _previous(df).withColumn("value", F.col("value") - F.col("v0")).drop("v0", "t0")
    if name == "rate":  # the interval is validated and otherwise unused: always per second
        up = F.when(F.col("value") < F.col("v0"), F.col("value")).otherwise(F.col("value") - F.col("v0"))
        return _previous(df).where("ts_ns > t0").withColumn("value", up / ((F.col("ts_ns") - F.col("t0")) / 1e9)).drop("v0", "t0")
    if name == "where":
        v, n = F.col("value"), F.lit(args[1])
        return df.where({">": v > n, ">=": v >= n, "<": v < n, "<=": v <= n, "==": v == n, "!=": v != n}[args[0]])
    if name == "math":
        return df.withColumn("value", _math(*args))
    if name == "abs":
        return df.withColumn("value", F.abs("value"))
    if name in ("ceil", "floor"):
        return df.withColumn("value", getattr(F, name)("value").cast("double"))
    if name == "round":
        return df.withColumn("value", F.round(F.col("value") * 10.0 ** args[0], 0) / 10.0 ** args[0])
    if name == "group_by":
        tag = F.coalesce(F.element_at("tags", F.lit(args[0])), F.lit("_untagged_"))
        base = F.split_part("series_key", F.lit(","), F.lit(1)) if called is None else F.lit(called)
        return df.select(F.concat(base, F.lit(f",{args[0]}="), tag).alias("series_key"), "field", F.create_map(F.lit(args[0]), tag).alias("tags"), "ts_ns", "pos", "value")
    if name in ("topk", "bottomk"):
        return _ranked(df, args[0], name == "topk")
    return df  # field and window act at plan time


def run_pipe(source: Source, text: str, now_ms: int | None = None, merged: bool = False, strict_limits: bool = False, most_scanned: int | None = MOST_SCANNED) -> DataFrame:
    """Runs a pipe query; merged serves all matching series as one tagless series. With strict_limits a query that
    scans or answers more points than a server would is an error; analytics do without. A server bounds what it scans
    because it holds all of it at once; with most_scanned None the scan has no bound, and only the answer has one.

    An alias renames series and merges none: stages behind it still tell them apart by their own keys.
    """
    query = parse(text, int(time.time() * 1000) if now_ms is None else now_ms)
    df, width, called = scan(source, query, merged), DEFAULT_WINDOW_MS, None
    if strict_limits and most_scanned is not None:
        df = guarded(df, most_scanned, "scan")
    for stage in query.stages:
        if stage.name == "window":
            width = stage.args[0]
        if stage.name == "alias":
            called = stage.args[0]
            continue
        df = apply_stage(df, stage, width, called)
        if stage.name == "group_by":
            called = None
    key = F.col("series_key") if called is None else F.lit(called)
    if strict_limits:
        df = guarded(df, MOST_ANSWERED, "answer")
    return df.select(key.alias("series_key"), "field", "ts_ns", "value")
