"""Reads of streams and queues, and sink shapes."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_at, json_kind
from .ordered import ordinals
from .records import parsed

#: Longest message of a queue in bytes (fixed value).
QUEUE_BYTES = 65_536


def read_stream(records: DataFrame, after: tuple[int, int] | None = None, until: tuple[int, int] | None = None, count: int | None = 1000, partition: int | None = None, key: str | None = None) -> DataFrame:
    """Records behind an exclusive start, in order; count is the page's size, None reads all of them, in no order.
    partition reads one partition of a stream that has that column, key the records of one key."""
    t, s = F.col("ts_ms"), F.col("seq")
    if partition is not None:
        records = records.where(F.col("partition") == partition)
    if key is not None:
        records = records.where(F.col("key") == key)
    if after is not None:
        records = records.where((t > after[0]) | ((t == after[0]) & (s > after[1])))
    if until is not None:
        records = records.where((t < until[0]) | ((t == until[0]) & (s <= until[1])))
    return records if count is None else records.orderBy("ts_ms", "seq").limit(count)


def tail_stream(records: DataFrame, count: int = 10) -> DataFrame:
    """The newest records, in order; count is the page's size."""
    return records.orderBy(F.desc("ts_ms"), F.desc("seq")).limit(count).orderBy("ts_ms", "seq")


def with_partition(records: DataFrame, partitions: int) -> DataFrame:
    """With the partition that a record's key gives it; a record without a key goes by its place."""
    if partitions < 1:
        raise ValueError("partitions must be positive")
    by = F.when(F.coalesce("key", F.lit("")) != "", F.xxhash64("key")).otherwise(F.col("seq"))
    return records.withColumn("partition", F.pmod(by, F.lit(partitions)).cast("int"))


def partition_info(records: DataFrame) -> DataFrame:
    """Per stream and partition: records, bytes, first and last place."""
    at = F.struct("ts_ms", "seq")
    out = records.groupBy("source", "partition").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("value")).alias("bytes"), F.min(at).alias("a"), F.max(at).alias("b"))
    return out.select("source", "partition", "records", "bytes", F.col("a.seq").alias("first_seq"), F.col("b.seq").alias("last_seq"))


def stream_info(records: DataFrame) -> DataFrame:
    at = F.struct("ts_ms", "seq")
    out = records.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("value")).alias("bytes"), F.min(at).alias("a"), F.max(at).alias("b"))
    return out.select("source", "records", "bytes", F.col("a.ts_ms").alias("first_ms"), F.col("a.seq").alias("first_seq"), F.col("b.ts_ms").alias("last_ms"), F.col("b.seq").alias("last_seq"))


def trim(records: DataFrame, before_ms: int | None = None, newest: int | None = None, max_age_ms: int | None = None, now_ms: int | None = None) -> DataFrame:
    """Trims each stream by exactly one of a time, a number of newest records and an age before now.

    A record stands for its batch. Of equal times the higher sequences count as newer.
    """
    if sum(x is not None for x in (before_ms, newest, max_age_ms)) != 1:
        raise ValueError("trim by exactly one of before, newest and max_age")
    if max_age_ms is not None:
        if now_ms is None or max_age_ms <= 0:
            raise ValueError("max_age must be positive and needs now")
        before_ms = now_ms - max_age_ms
    if before_ms is not None:
        return records.where(F.col("ts_ms") >= before_ms)
    if newest <= 0:
        raise ValueError("newest must be positive")
    total = records.groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("_total"))
    placed = ordinals(records, ["source"], ["ts_ms", "seq"], "_place")
    kept = placed.join(total, F.col("source").eqNullSafe(F.col("_source"))).where(F.col("_place") > F.col("_total") - newest)
    return kept.drop("_place", "_source", "_total")


def trim_report(records: DataFrame, **bound: int) -> DataFrame:
    """A trim's dry run: per stream what would go and the first sequence that would stay."""
    stay = trim(records, **bound).groupBy("source").agg(F.count(F.lit(1)).alias("stays"), F.min(F.struct("ts_ms", "seq")).alias("first"))
    every = records.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return every.join(stay, "source", "left").select("source", (F.col("n") - F.coalesce("stays", F.lit(0))).alias("deleted"), F.coalesce("first.seq", F.lit(0)).alias("first_seq"))


def ready(queue: DataFrame, now_ns: int, count: int) -> DataFrame:
    """Next messages: lowest priority value, then due time, then sequence; count is the page's size."""
    due = queue.where((F.col("status") == "ready") & (F.col("due_ns") <= now_ns))
    return due.orderBy("priority", "due_ns", "seq").limit(count).select("queue", "seq", "priority", "due_ns")


def queue_stats(queue: DataFrame) -> DataFrame:
    return queue.groupBy("queue").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ready", "leased", "dead")])


def sink_stream(records: DataFrame) -> DataFrame:
    """A stream sink appends the value only."""
    return records.select("value")


def sink_kv(records: DataFrame, prefix: str = "", separator: str = ":", ttl_ms: int | None = None, now_ms: int | None = None) -> DataFrame:
    """Last value of each key; a record without key and prefix goes, one with a prefix alone is kept under
    prefix and separator.

    With a time to live there is also expiry_ns, counted from now or else from the last record's own stamp.
    """
    key = F.concat(F.lit(prefix + separator if prefix else ""), F.coalesce("key", F.lit("")))
    keyed = records.select(key.alias("key"), "value", "ts_ms", "seq").where("key <> ''")
    at = F.struct("ts_ms", "seq")
    last = keyed.groupBy("key").agg(F.max_by("value", at).alias("value"), F.max("ts_ms").alias("ts_ms"))
    if ttl_ms is None:
        return last.select("key", "value")
    if ttl_ms <= 0:
        raise ValueError("ttl must be positive")
    start = F.col("ts_ms") if now_ms is None else F.lit(now_ms)
    return last.select("key", "value", ((start + ttl_ms) * 1_000_000).alias("expiry_ns"))


def sink_queue(records: DataFrame, priority: int = 0) -> DataFrame:
    if not 0 <= priority <= 255:
        raise ValueError("priority must be 0 to 255")
    return records.where(F.octet_length("value") <= QUEUE_BYTES).select("value", F.lit(priority).alias("priority"))


def points_made(records: DataFrame, measurement: str, fields: dict[str, str] | None = None, tags: dict[str, str] | None = None, value_field: str = "value") -> DataFrame:
    """sink_points() with what is dropped, as rows with a null value."""
    doc, number = F.col("_doc"), lambda p: F.when(json_kind(F.col("_doc"), p) == "NUMBER", json_at(F.col("_doc"), p, "double"))
    text = lambda p: F.when(json_kind(doc, p) == "STRING", json_at(doc, p, "string"))
    tag_map = F.map_filter(F.map_from_arrays(F.array(*[F.lit(t) for t in tags or {}]).cast("array<string>"), F.array(*[text(p) for p in (tags or {}).values()]).cast("array<string>")), lambda _, v: v.isNotNull())
    if fields:
        made = F.array(*[F.struct(F.lit(f).alias("field"), number(p).alias("value")) for f, p in fields.items()])
    else:
        made = F.array(F.struct(F.lit("value").alias("field"), F.coalesce(number(value_field), F.col("value").try_cast("double")).alias("value")))
    out = parsed(records).select(tag_map.alias("tags"), "ts_ms", "seq", F.inline(made))
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    return out.select(F.lit(measurement).alias("measurement"), "field", "tags", (F.col("ts_ms") * 1_000_000).alias("ts_ns"), F.col("seq").alias("pos"), F.when(finite, F.col("value")).alias("value"))


def sink_points(records: DataFrame, measurement: str, fields: dict[str, str] | None = None, tags: dict[str, str] | None = None, value_field: str = "value") -> DataFrame:
    """One point for each numeric field named in the map; else the field `value` alone: the number at value_field,
    or else the whole value as a number. What isn't a finite number goes."""
    return points_made(records, measurement, fields, tags, value_field).where("value is not null")


def forwarded(records: DataFrame, measurement: str, field: str = "value") -> DataFrame:
    """forward_points() with what is dropped, as rows with a null value."""
    out = records.withColumn("_p", F.from_json("src", "ts_ns long, tags map<string,string>, value double"))
    tags = F.coalesce("_p.tags", F.create_map().cast("map<string,string>"))
    finite = ~F.isnan("_p.value") & (F.abs("_p.value") < float("inf"))
    return out.select(F.lit(measurement).alias("measurement"), F.lit(field).alias("field"), tags.alias("tags"), F.col("_p.ts_ns").alias("ts_ns"), F.col("seq").alias("pos"), F.when(finite, F.col("_p.value")).alias("value"))


def forward_points(records: DataFrame, measurement: str, field: str = "value") -> DataFrame:
    """From a ts source: the source point's own value, time and tags under another name."""
    return forwarded(records, measurement, field).where("value is not null")


def dead_letters(queue: DataFrame, count: int, after: tuple[int, int] | None = None) -> DataFrame:
    """A page of dead messages, the longest dead first, behind an exclusive cursor (dead_ns, seq)."""
    dead = queue.where(F.col("status") == "dead")
    if after is not None:
        t, s = F.col("dead_ns"), F.col("seq")
        dead = dead.where((t > after[0]) | ((t == after[0]) & (s > after[1])))
    return dead.orderBy("dead_ns", "seq").limit(count).select("queue", "seq", "dead_ns")


def newest(records: DataFrame, count: int, search: str | None = None) -> DataFrame:
    """Newest first, with an optional substring search in lower case; count is the page's size."""
    if search:
        records = records.where(F.lower("value").contains(search.lower()))
    return records.orderBy(F.desc("ts_ms"), F.desc("seq")).limit(count)


def list_runs(runs: DataFrame, count: int, workflow: str | None = None, status: str | None = None, search: str | None = None, after: tuple[int, str] | None = None) -> DataFrame:
    """A page of runs (run_id, workflow, status, step, input, tags, started_ms, created_ms), newest first, then by
    id; the search, in lower case, is a part of the id, workflow, step, input or tags; after is the last row's
    (created_ms, run_id)."""
    at = F.coalesce("started_ms", "created_ms")
    out = runs.withColumn("at_ms", at)
    if workflow:
        out = out.where(F.col("workflow") == workflow)
    if status:
        out = out.where(F.col("status") == status)
    if search:
        hits = [F.coalesce(F.lower(c).contains(search.lower()), F.lit(False)) for c in ("run_id", "workflow", "step", "input", "tags")]
        out = out.where(functools.reduce(operator.or_, hits))
    if after is not None:
        out = out.where((F.col("at_ms") < after[0]) | ((F.col("at_ms") == after[0]) & (F.col("run_id") > after[1])))
    return out.orderBy(F.desc("at_ms"), "run_id").limit(count).select("run_id", "workflow", "status", F.col("at_ms").alias("created_ms"))
