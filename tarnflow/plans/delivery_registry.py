"""Registered queries of delivery, schedules, listings and sinks of point sources, with DuckDB SQL for their rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.schedule import latest_fire
from ..operators import delivery, keyvalue, logs, records
from ..sources import tables as t
from ..operators.points import exact_tags
from ..streaming.lateness import ready_points
from ..streaming.runner import points_as_records, run_chain, to_sinks
from .job_definition import parse_job

DAY_MS, LOW, HIGH = 86_400_000, 1704067200000, 1706745600000
_MS = "epoch_us(ts) // 1000"
QUERIES, ORACLES = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _user_queues(spark, sf_dir, more):
    """A queue for each user: its events go in, then what `more` adds for each queue comes."""
    ev = t.table(spark, sf_dir, "events")
    scope = F.concat(F.lit("u"), "user_id")
    put = ev.select(scope.alias("scope"), F.col("event_id").alias("seq"), F.lit("enqueue").alias("op"), F.floor(t.micros("ts") / 1000).alias("at_ms"), F.length("event_type").alias("priority"), F.octet_length("event_type").cast("long").alias("bytes"))
    return put.unionByName(more(ev.select(scope.alias("scope")).distinct()), allowMissingColumns=True)


def _deliver(spark, sf_dir):
    take = lambda q: q.select("scope", F.lit(10**12).alias("seq"), F.lit("deliver").alias("op"), F.lit(HIGH).alias("at_ms"), F.lit("w").alias("holder"), F.lit(20).alias("count"))
    return delivery.fold_deliveries(_user_queues(spark, sf_dir, take)).where("op = 'deliver'").select("scope", "msg", "outcome", "delivery", "until_ms")


_PUT = "q AS (SELECT 'u' || user_id AS scope, length(event_type) AS priority, event_id, epoch_us(ts) // 1000 AS due, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS msg FROM events), p AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY priority, due, msg) AS n FROM q)"
_add("queue_deliver", _deliver, f"WITH {_PUT} SELECT scope, msg, 'leased' AS outcome, CAST(1 AS INTEGER) AS delivery, CAST({HIGH + 30_000} AS BIGINT) AS until_ms FROM p WHERE n <= 20")


def _leases_run_out(spark, sf_dir):
    """Twenty messages of each queue are taken and never completed; a minute later their leases have run out."""

    def more(q):
        ops = [F.struct(F.lit(10**12 + i).alias("seq"), F.lit(op).alias("op"), F.lit(HIGH + i * 60_000).alias("at_ms"), F.lit("w").alias("holder"), F.lit(20).alias("count")) for i, op in enumerate(("deliver", "tick"))]
        return q.select("scope", F.explode(F.array(*ops)).alias("o")).select("scope", "o.*")

    return delivery.fold_deliveries(_user_queues(spark, sf_dir, more)).where("op = 'tick'").select("scope", "msg", "outcome", "delivery", "until_ms")


_add("queue_leases_run_out", _leases_run_out, f"WITH {_PUT} SELECT scope, msg, 'expired_ready' AS outcome, CAST(1 AS INTEGER) AS delivery, CAST({HIGH + 30_000} AS BIGINT) AS until_ms FROM p WHERE n <= 20")


def _queue_states(spark, sf_dir):
    """Twenty messages of each queue are taken; the first ten are completed, the rest are failed for good."""

    def more(q):
        take = q.select("scope", F.lit(10**12).alias("seq"), F.lit("deliver").alias("op"), F.lit(HIGH).alias("at_ms"), F.lit("w").alias("holder"), F.lit(None).cast("long").alias("msg"), F.lit(None).cast("int").alias("delivery"), F.lit(20).alias("count"), F.lit(None).cast("boolean").alias("dead"))
        done = q.select("scope", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(20).cast("long"))).alias("msg")).select("scope", (F.col("msg") + 10**12).alias("seq"), F.when(F.col("msg") <= 10, "complete").otherwise("fail").alias("op"), F.lit(HIGH + 1).alias("at_ms"), F.lit("w").alias("holder"), "msg", F.lit(1).alias("delivery"), F.lit(None).cast("int").alias("count"), F.lit(True).alias("dead"))
        return take.unionByName(done)

    return delivery.message_states(delivery.fold_deliveries(_user_queues(spark, sf_dir, more))).groupBy("scope", "state").agg(F.count(F.lit(1)).alias("n"))


_add("queue_states", _queue_states, f"WITH {_PUT} SELECT scope, CASE WHEN n > 20 THEN 'ready' WHEN msg <= 10 THEN 'gone' WHEN msg <= 20 THEN 'dead' ELSE 'leased' END AS state, count(*) AS n FROM p GROUP BY ALL")


def _daily_reads(spark, sf_dir):
    events = t.event_stream(spark, sf_dir)
    kinds = t.table(spark, sf_dir, "events").select("event_type").distinct()
    stream = events.withColumn("source", F.get_json_object("value", "$.type"))
    reads = kinds.select(F.col("event_type").alias("stream"), F.lit("g").alias("group"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(30).cast("long"))).alias("day"))
    ops = reads.select("stream", "group", F.col("day").alias("seq"), F.lit("read").alias("op"), (F.lit(LOW) + F.col("day") * DAY_MS - 1).alias("at_ms"), F.lit("w").alias("holder"), F.lit(50).alias("count"), F.lit(10 * 365 * DAY_MS).alias("lease_ms"))
    return stream, ops


def _group_reads(spark, sf_dir):
    stream, ops = _daily_reads(spark, sf_dir)
    return delivery.group_deliveries(ops, stream).where("outcome = 'leased'").select("stream", "group", "seq", "msg", "record_seq")


# after k reads the cursor stands at the least, over j <= k, of what there was at read j and 50 for each read since
_CURSOR = f"""a AS (SELECT s.event_type AS stream, d.day AS seq, (SELECT count(*) FROM events e WHERE e.event_type = s.event_type AND epoch_us(e.ts) // 1000 <= {LOW} + d.day * {DAY_MS} - 1) AS available
  FROM (SELECT DISTINCT event_type FROM events) s, (SELECT CAST(unnest(range(1, 31)) AS BIGINT) AS day) d),
c AS (SELECT stream, seq, 50 * seq + least(0, min(available - 50 * seq) OVER (PARTITION BY stream ORDER BY seq)) AS upto FROM a),
r AS (SELECT event_type AS stream, event_id, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS msg FROM events)"""
_add("group_reads", _group_reads, f"WITH {_CURSOR} SELECT r.stream, 'g' AS \"group\", min(c.seq) AS seq, r.msg, r.event_id AS record_seq FROM r JOIN c ON c.stream = r.stream AND c.upto >= r.msg GROUP BY r.stream, r.msg, r.event_id")


def _group_members(spark, sf_dir):
    stream, ops = _daily_reads(spark, sf_dir)
    turns = ops.withColumn("holder", F.concat(F.lit("w"), F.col("seq") % 3))
    return delivery.members(delivery.group_deliveries(turns, stream))


_add("group_members", _group_members, f"WITH {_CURSOR}, f AS (SELECT r.stream, r.msg, min(c.seq) AS seq FROM r JOIN c ON c.stream = r.stream AND c.upto >= r.msg GROUP BY r.stream, r.msg) SELECT stream, 'g' AS \"group\", 'w' || (seq % 3) AS holder, count(*) AS held FROM f GROUP BY ALL")

_add("queue_dead_letters", lambda spark, sf: logs.dead_letters(t.order_queue(spark, sf).withColumn("dead_ns", F.col("due_ns")), 50, (800000000000000000, 0)), "SELECT 'orders' AS queue, o_orderkey AS seq, epoch_us(o_orderdate) * 1000 AS dead_ns FROM orders WHERE o_orderstatus NOT IN ('O', 'P') AND (epoch_us(o_orderdate) * 1000, o_orderkey) > (800000000000000000, 0) ORDER BY 3, 2 LIMIT 50")
_add("stream_trim_max_age", lambda spark, sf: logs.trim(t.event_stream(spark, sf), max_age_ms=5 * DAY_MS, now_ms=HIGH).select("seq"), f"SELECT event_id AS seq FROM events WHERE {_MS} >= {HIGH - 5 * DAY_MS}")
_add("stream_trim_report", lambda spark, sf: logs.trim_report(t.event_stream(spark, sf), newest=77), f"SELECT 'events' AS source, greatest(count(*) - 77, 0) AS deleted, (SELECT event_id FROM (SELECT event_id, {_MS} AS ms FROM events ORDER BY ms DESC, event_id DESC LIMIT 77) ORDER BY ms, event_id LIMIT 1) AS first_seq FROM events")
_add("kv_namespaces", lambda spark, sf: keyvalue.namespace_summary(t.order_versions(spark, sf).withColumn("ns", F.concat(F.lit("n"), F.substring("key", -1, 1)))), "WITH v AS (SELECT 'n' || right(CAST(o_custkey AS VARCHAR), 1) AS ns, o_custkey, o_orderkey, o_orderstatus = 'F' AS gone, strlen(CAST(o_totalprice AS VARCHAR)) AS size FROM orders), k AS (SELECT ns, o_custkey, arg_max(gone, o_orderkey) AS gone, count(*) AS n, sum(size) AS bytes FROM v GROUP BY ALL) SELECT ns, count(*) FILTER (NOT gone) AS keys, CAST(sum(n) AS BIGINT) AS versions, CAST(sum(bytes) AS BIGINT) AS bytes FROM k GROUP BY ns")
_add("schedule_latest", lambda spark, sf: t.table(spark, sf, "events").select("event_id", latest_fire(F.floor(t.micros("ts") / 1000), "30 6 * * *").alias("fire_ms")), "SELECT event_id, epoch_ms(CASE WHEN hour(ts) * 60 + minute(ts) >= 390 THEN date_trunc('day', ts) ELSE date_trunc('day', ts) - INTERVAL 1 DAY END) + 390 * 60000 AS fire_ms FROM events")


def _runs(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    return o.select(F.concat(F.lit("run-"), "o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("workflow"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), none.alias("step"), F.col("o_orderpriority").alias("input"), none.alias("tags"), F.lit(None).cast("long").alias("started_ms"), F.floor(t.micros("o_orderdate") / 1000).alias("created_ms"))


_add("runs_list", lambda spark, sf: logs.list_runs(_runs(spark, sf), 100, status="running", search="URGENT"), "SELECT 'run-' || o_orderkey AS run_id, o_orderpriority AS workflow, 'running' AS status, epoch_us(o_orderdate) // 1000 AS created_ms FROM orders WHERE o_orderstatus <> 'F' AND contains(lower(o_orderpriority), 'urgent') ORDER BY created_ms DESC, run_id LIMIT 100")

_JOB = json.dumps({"kind": "Processing", "name": "forward", "sources": [{"ts": {"measurement": "click"}}], "operators": [{"type": "filter", "condition": "json:$.value>50"}, {"type": "map", "v": "$.timestamp_ms"}], "sinks": [{"ts": {"measurement": "big", "value_field": "v"}}]})


def _forward(spark, sf_dir):
    job = parse_job(_JOB)
    out = run_chain(job, {"click": t.event_points(spark, sf_dir)})
    return to_sinks(job, out)[0][1].select("measurement", "field", F.element_at("tags", "user").alias("user"), "ts_ns", "value")


_add("job_points_forward", _forward, "SELECT 'big' AS measurement, 'v' AS field, CAST(user_id AS VARCHAR) AS user, epoch_us(ts) * 1000 AS ts_ns, value FROM (SELECT *, max(epoch_us(ts)) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM events WHERE event_type = 'click') WHERE value > 50 AND coalesce(newest - epoch_us(ts) <= 30000000, true)")
_add("job_points_held_back", lambda spark, sf: points_as_records(ready_points(t.event_points(spark, sf).where((F.col("measurement") == "click") & exact_tags({"user": "7"})), DAY_MS), "click").select("seq", F.col("ts_ms")), f"WITH p AS (SELECT *, epoch_us(ts) AS us, max(epoch_us(ts)) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest, max(epoch_us(ts)) OVER () AS last FROM events WHERE event_type = 'click' AND user_id = 7) SELECT event_id AS seq, us // 1000 AS ts_ms FROM p WHERE us <= last - {DAY_MS * 1000} AND coalesce(newest - us <= {DAY_MS * 1000}, true)")
_add("job_ordinals", lambda spark, sf: records.ordinals(records.key_by(t.event_stream(spark, sf), "$.type"), ["key"], ["ts_ms", "seq"], rows=1000).select("key", "seq", "ordinal"), f"SELECT event_type AS key, event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY {_MS}, event_id) AS ordinal FROM events")
