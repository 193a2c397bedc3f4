"""Runs job chains in batch and in Structured Streaming with the same operators."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import logs, records
from ..operators.points import exact_tags
from ..plans.job_definition import Endpoint, Job, Step
from .lateness import hold_back, mark_late
from .user_functions import apply_function

#: A row a sink and batch: what it took and what of it was dropped.
COUNTERS = "sink int, kind string, name string, taken long, dropped long"
_STATE = "n long, total double, least double, most double"
_OUT = "source string, key string, value double, count long, event_time_ms long, ts_ms long, seq long"
_OUT_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_NONE = (0, 0.0, float("inf"), float("-inf"))


def stateful_aggregate(df: DataFrame, function: str, path: str | None = None, size: int | None = None) -> DataFrame:
    """Running or count-window aggregates with state that survives restarts, by (ts_ms, seq) within a batch."""

    carried = ["src"] if "src" in df.columns else []

    def of(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n0, total0, least0, most0 = state.get if state.exists else _NONE
        pdf = pd.concat(list(pdfs)).sort_values(["ts_ms", "seq"], kind="stable", ignore_index=True)
        x, place = pdf["x"].to_numpy(), n0 + np.arange(len(pdf))
        window = np.zeros(len(pdf), np.int64) if size is None else place // size
        by = pdf["x"].groupby(window)
        n, total, least, most = by.cumcount().to_numpy() + 1, by.cumsum().to_numpy(), by.cummin().to_numpy(), by.cummax().to_numpy()
        first = window == window[0]  # goes on with what the state holds
        n[first] += n0
        total[first] += total0
        least[first], most[first] = np.minimum(least[first], least0), np.maximum(most[first], most0)
        value = {"sum": total, "count": n.astype(float), "avg": total / n, "min": least, "max": most}[function]
        full = np.ones(len(pdf), bool) if size is None else n == size
        state.update(_NONE if size is not None and full[-1] else (int(n[-1]), float(total[-1]), float(least[-1]), float(most[-1])))
        out = pdf[full].assign(value=value[full], count=n[full], source=key[0], key=key[1])
        yield out[_OUT_NAMES + carried]

    taken = records.aggregate_input(df, function, path).select("source", "key", "x", "event_time_ms", "ts_ms", "seq", *carried)
    return taken.groupBy("source", "key").applyInPandasWithState(of, _OUT + (", src string" if carried else ""), _STATE, "append", GroupStateTimeout.NoTimeout)


def apply_step(df: DataFrame, step: Step, kv: Callable[[str], DataFrame] | None) -> DataFrame:
    s = step.settings
    match step.kind:
        case "function":
            return apply_function(df, s["function"])
        case "filter":
            return records.filter_records(df, s["condition"])
        case "map":
            return records.map_records(df, s["mapping"])
        case "keyby":
            return records.key_by(df, s["key_expression"])
        case "flatmap":
            return records.flat_map(df, s["array_field"], s.get("element_key"))
        case "classify":
            return records.classify(df, [(r["condition"], r["tag"]) for r in s["rules"]], s.get("default_tag"))
        case "kv_lookup":
            live = kv(s.get("namespace", "default"))
            if s.get("mode", "filter") == "filter":
                return records.lookup_filter(df, s["lookup_key"], live)
            return records.lookup_enrich(df, s["lookup_key"], live, s.get("enrich_field", "_kv"))
        case "aggregate":
            size = s.get("window_size")
            if df.isStreaming:
                out = stateful_aggregate(df, s["function"], s.get("field"), size)
            elif size:
                out = records.count_window_aggregate(df, s["function"], size, s.get("field"))
            else:
                out = records.running_aggregate(df, s["function"], s.get("field"))
            return records.aggregate_json(out)
    return df


def source_records(source: Endpoint, df: DataFrame, idle: bool = True) -> DataFrame:
    """A source's records, of a frame of records or, for a ts source, of points: its field and its exact tags, late
    points told apart and left out, held back on a stream."""
    if "ts_ns" not in df.columns:
        return df
    s = source.settings
    points = df.where((F.col("measurement") == s["measurement"]) & (F.col("field") == (s["field"] or "value")))
    if s["tags"]:
        points = points.where(exact_tags(s["tags"]))
    marked = hold_back(points, s["lateness_ms"], idle).observe("late_points", F.count_if("late").alias("late")) if df.isStreaming else mark_late(points, s["lateness_ms"])
    return points_as_records(marked.where("not late").drop("late"), s["measurement"], s["field"] or "value")


def blocking_read(live: DataFrame, after: tuple[int, int] | None = None, count: int = 1000, timeout_s: float = 30.0) -> list:
    """Waits for records of a stream behind a place and returns the first page that has some, in order; an empty page
    once the time is over. count, the page's size, bounds what the driver gets."""
    found: list = []
    arrived = threading.Event()

    def take(batch: DataFrame, _: int) -> None:
        if not found:
            found.extend(logs.read_stream(batch, after, None, count).collect())
            if found:
                arrived.set()

    query = live.writeStream.foreachBatch(take).trigger(processingTime="100 milliseconds").start()
    try:
        arrived.wait(timeout_s)
    finally:
        query.stop()
    return found


def seen_times(df: DataFrame) -> DataFrame:
    """A source whose newest time is observed for the job's status; it drives nothing."""
    if not df.isStreaming:
        return df
    at = F.expr("ts_ns div 1000000L") if "ts_ns" in df.columns else F.col("event_time_ms")
    return df.observe(f"newest_{uuid.uuid4().hex}", F.max(at).alias("newest_ms"))


def run_chain(job: Job, sources: dict[str, DataFrame], kv: Callable[[str], DataFrame] | None = None, steps: tuple[Step, ...] | None = None, idle: bool = True) -> DataFrame:
    """The union of every source's own chain; sources by the stream or measurement that they read."""
    out = None
    for s in job.sources:
        df = source_records(s, sources[s.reads], idle)
        for step in job.operators if steps is None else steps:
            df = apply_step(df, step, kv)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def points_as_records(points: DataFrame, measurement: str, field: str = "value") -> DataFrame:
    """A ts source: {"measurement","value","timestamp_ms"} for each point of the field.

    src carries the point itself, which a ts sink forwards whatever the chain made of the value."""
    df = points.where((F.col("measurement") == measurement) & (F.col("field") == field))
    ms = F.expr("ts_ns div 1000000L")
    body = F.concat(F.lit('{"measurement":' + json.dumps(measurement, ensure_ascii=False) + ',"value":'), F.col("value").cast("string"), F.lit(',"timestamp_ms":'), ms.cast("string"), F.lit("}"))
    return df.select(F.lit(measurement).alias("source"), F.lit("").alias("key"), body.alias("value"), ms.alias("event_time_ms"), F.expr(records.NO_TAGS).alias("tags"), ms.alias("ts_ms"), F.col("pos").alias("seq"), F.to_json(F.struct("ts_ns", "tags", "value")).alias("src"))


def to_sinks(job: Job, out: DataFrame, seen: list[Observation] | None = None) -> list[tuple[str, DataFrame]]:
    """What each sink of the job gets; seen, one for each sink, count what it takes and what it drops."""
    made = []
    for i, s in enumerate(job.sinks):
        df, o = records.route(out, list(s.match)), s.settings
        count = lambda df, bad, i=i: df if seen is None else df.observe(seen[i], F.count(F.lit(1)).alias("taken"), F.count_if(bad).alias("dropped"))
        if s.kind == "stream":
            df = logs.sink_stream(count(df, F.lit(False)))
        elif s.kind == "kv":
            df = logs.sink_kv(count(df, F.lit(not o["key_prefix"]) & (F.coalesce("key", F.lit("")) == "")), o["key_prefix"], o["separator"], o["ttl_ms"])
        elif s.kind == "queue":
            df = logs.sink_queue(count(df, F.octet_length("value") > logs.QUEUE_BYTES), o["priority"])
        else:
            points = logs.points_made(df.where("src is null") if "src" in df.columns else df, o["measurement"], o["fields"], o["tags"], o["value_field"])
            if "src" in df.columns:
                points = logs.forwarded(df.where("src is not null"), o["measurement"], o["value_field"]).unionByName(points)
            df = count(points, F.col("value").isNull()).where("value is not null")
        made.append((s.kind, df))
    return made


def start_job(job: Job, sources: dict[str, DataFrame], folder: str, kv: Callable[[str], DataFrame] | None = None, available_now: bool = True):
    """Starts the job on streaming sources; each micro-batch writes every sink under its batch id, so that a
    batch that is run again replaces what it wrote before, and its counters beside it.

    Lookups read kv anew in each micro-batch, where no aggregate is ahead of them in the chain.
    """
    cut = next((i for i, step in enumerate(job.operators) if step.kind == "kv_lookup"), len(job.operators))
    if any(step.kind == "aggregate" for step in job.operators[cut:]):
        cut = len(job.operators)  # keyed state lives in the stream, so the chain stays there
    later = job.operators[cut:]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # one chain output, several sinks
        out = batch
        for step in later:
            out = apply_step(out, step, kv)
        seen = [Observation() for _ in job.sinks]
        for i, (kind, df) in enumerate(to_sinks(job, out, seen)):
            df.write.mode("overwrite").parquet(f"{folder}/sink{i}-{kind}/batch={batch_id}")
        counters = [(i, s.kind, s.name, seen[i].get["taken"], seen[i].get["dropped"]) for i, s in enumerate(job.sinks)]
        batch.sparkSession.createDataFrame(counters, COUNTERS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/counters/batch={batch_id}")
        batch.unpersist()

    whole = run_chain(job, {k: seen_times(df) for k, df in sources.items()}, kv, job.operators[:cut], not available_now)
    writer = whole.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").queryName(job.name)
    poll = min(s.settings["poll_interval_ms"] for s in job.sources)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{poll} milliseconds")).start()
