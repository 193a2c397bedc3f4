"""Registered queries of whole job chains, of every kind of condition, of chained pipes and of key-value folds."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import keyvalue, logs, records
from ..operators.catalog import current_catalog, fold_catalog
from ..operators.points import dashboard_page, names_page, page_status
from ..operators.series import ranking, run_pipe
from ..sources import tables as t
from ..streaming import event_time
from ..streaming.lateness import mark_late
from ..streaming.runner import run_chain, to_sinks
from .job_definition import parse_job

LOW, HIGH = 1704067200000, 1706745600000
QUERIES, ORACLES = {}, {}


def _add(name, query, sql):
    QUERIES[name] = query
    ORACLES[name] = sql


def _by_type(spark, sf_dir):
    return records.key_by(t.event_stream(spark, sf_dir), "$.type")


for _n, _c, _sql in (
    ("key_equals", "key_equals:click", "event_type = 'click'"), ("key_prefix", "key_prefix:c", "starts_with(event_type, 'c')"), ("key_contains", "key_contains:ic", "contains(event_type, 'ic')"), ("key_not_empty", "key_not_empty", "event_type <> ''"),
    ("not_empty", "not_empty", "true"), ("value_prefix", 'value_prefix:{"event_id":1', "starts_with(CAST(event_id AS VARCHAR), '1')"), ("json_contains", "json:$.type*=ic", "contains(event_type, 'ic')"),
    ("json_not_contains", "json:$.type!*=ic", "NOT contains(event_type, 'ic')"), ("json_not_prefix", "json:$.type!^=c", "NOT starts_with(event_type, 'c')"), ("json_less", "json:$.amount<12.5", "value < 12.5"), ("json_at_least", "json:$.amount>=75", "value >= 75"),
    ("json_number_not", "json:$.event_id!=7", "event_id <> 7"), ("json_bool_not", "json:$.large!=true", "value <= 50"), ("json_text_on_number", "json:$.amount^=1", "false"),
    ("eight_parts", " OR ".join(f"json:$.event_id={i}" for i in range(1, 9)), "event_id BETWEEN 1 AND 8"),
):
    _add(f"job_filter_{_n}", lambda spark, sf, c=_c: records.filter_records(_by_type(spark, sf), c).select("seq"), f"SELECT event_id AS seq FROM events WHERE {_sql}")


def _job(operators, sinks):
    return parse_job(json.dumps({"kind": "Processing", "name": "chain", "sources": [{"stream": {"name": "events"}}], "operators": operators, "sinks": sinks}))


def _chain(spark, sf_dir, operators, sinks, which=0):
    job = _job(operators, sinks)
    return to_sinks(job, run_chain(job, {"events": t.event_stream(spark, sf_dir)}))[which][1]


_RULES = [{"condition": "json:$.type=error", "tag": "errors"}, {"condition": "json:$.amount>80", "tag": "high"}]
_PICKED = [{"stream": {"name": "all"}}, {"stream": {"name": "e"}, "match": "errors"}, {"stream": {"name": "both"}, "match": ["errors", "high"]}]
for _i, (_n, _sql) in enumerate((("all", "true"), ("errors", "event_type = 'error'"), ("both", "event_type = 'error' AND value > 80"))):
    _add(f"sink_stream_{_n}", lambda spark, sf, i=_i: _chain(spark, sf, [{"type": "passthrough"}, {"type": "classify", "rules": _RULES}], _PICKED, i).select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id")), f"SELECT event_id FROM events WHERE {_sql}")
# a map after the rules clears the tags, so a sink with a match gets nothing
_add("job_map_clears_tags", lambda spark, sf: _chain(spark, sf, [{"type": "classify", "rules": _RULES}, {"type": "map", "id": "$.event_id"}], _PICKED, 1), "SELECT CAST(event_id AS VARCHAR) AS value FROM events WHERE false")
_add("job_chain_keyed_count", lambda spark, sf: _chain(spark, sf, [{"type": "filter", "condition": "json:$.amount>50"}, {"type": "keyby", "key_expression": "$.user"}, {"type": "aggregate", "function": "count"}], [{"kv": {"key_prefix": "n"}}]).select("key", F.get_json_object("value", "$.count").cast("long").alias("n")), "SELECT 'n:u' || user_id AS key, count(*) AS n FROM events WHERE value > 50 GROUP BY 1")
_add("sink_kv_ttl", lambda spark, sf: _chain(spark, sf, [{"type": "keyby", "key_expression": "$.user"}], [{"kv": {"key_prefix": "last", "separator": "/", "ttl_ms": 7_200_000}}]).select("key", F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), "expiry_ns"), "SELECT 'last/u' || user_id AS key, arg_max(event_id, (epoch_us(ts) // 1000, event_id)) AS event_id, (max(epoch_us(ts) // 1000) + 7200000) * 1000000 AS expiry_ns FROM events GROUP BY 1")
_add("sink_points_value", lambda spark, sf: logs.sink_points(t.event_stream(spark, sf).withColumn("value", F.when(F.col("seq") % 3 == 0, F.lit("NaN")).when(F.col("seq") % 3 == 1, F.lit("text")).otherwise(F.get_json_object("value", "$.amount"))), "m").select("field", "ts_ns", "pos", "value"), "SELECT 'value' AS field, epoch_us(ts) // 1000 * 1000000 AS ts_ns, event_id AS pos, value FROM events WHERE event_id % 3 = 2")


def _pipe(text, merged=False):
    return lambda spark, sf: run_pipe(lambda a, b: t.event_points(spark, sf, a, b), text, HIGH, merged).withColumn("value", F.round("value", 6))


_EV = "e AS (SELECT event_type AS m, 'user=' || user_id AS tag, epoch_us(ts) * 1000 AS ts_ns, event_id AS pos, value AS v FROM events WHERE event_type = 'click')"
_add("pq_range_lower", _pipe("click[1705000000000]"), f"WITH {_EV} SELECT m || ',' || tag AS series_key, 'value' AS field, ts_ns, round(v, 6) AS value FROM e WHERE ts_ns BETWEEN 1705000000000000000 AND {HIGH}000000")
_add("pq_window_chain", _pipe(f"click[{LOW}..{HIGH}] | window(1h) | avg() | window(1d) | max()", True), f"""WITH {_EV}, o AS (SELECT min(ts_ns) AS o FROM e),
h AS (SELECT o + (ts_ns - o) // 3600000000000 * 3600000000000 AS ts_ns, avg(v) AS v, o FROM e, o GROUP BY o, (ts_ns - o) // 3600000000000)
SELECT 'click' AS series_key, 'value' AS field, o + (ts_ns - o) // 86400000000000 * 86400000000000 AS ts_ns, round(max(v), 6) AS value FROM h GROUP BY o, (ts_ns - o) // 86400000000000""")
_add("pq_topk_all", _pipe(f"click[{LOW}..{HIGH}] | topk(1000000)"), f"WITH {_EV} SELECT m || ',' || tag AS series_key, 'value' AS field, ts_ns, round(v, 6) AS value FROM e")
_add("pq_topk_none", _pipe(f"click[{LOW}..{HIGH}] | topk(0)"), f"WITH {_EV} SELECT m || ',' || tag AS series_key, 'value' AS field, ts_ns, round(v, 6) AS value FROM e WHERE false")


def _documents(spark, sf_dir, *steps):
    """Each customer's key is set to its document, then goes through the steps (op, arg, path, ttl_ns, at_ns)."""
    live = t.customer_kv(spark, sf_dir)
    every = [("set", None, None, None, 0), *steps]
    lit = lambda x, kind: F.lit(x).cast(kind)
    ops = [F.struct(F.lit(i).cast("long").alias("seq"), lit(op, "string").alias("op"), (F.col("value") if i == 0 else lit(arg, "string")).alias("arg"), lit(path, "string").alias("path"), lit(ttl, "long").alias("ttl_ns"), lit(at, "long").alias("at_ns")) for i, (op, arg, path, ttl, at) in enumerate(every)]
    return keyvalue.fold_operations(live.select("key", F.explode(F.array(*ops)).alias("o")).select("key", "o.*"))


_KEY = "'customer:' || c_custkey AS key"
_add("kv_json_set", lambda spark, sf: _documents(spark, sf, ("json_set", "[1,2]", "$.marks", None, 1), ("json_set", "3", "$.marks[2]", None, 2), ("json_del", None, "$.marks[0]", None, 3), ("json_set", "1", "$.no.such", None, 4)).select("key", "seq", "applied", "version", F.get_json_object("value", "$.marks").alias("marks")), f"SELECT {_KEY}, s.seq, s.applied, s.version, s.marks FROM customer, (VALUES (0::BIGINT, true, 1::BIGINT, NULL), (1, true, 2, '[1,2]'), (2, true, 3, '[1,2,3]'), (3, true, 4, '[2,3]'), (4, false, 4, '[2,3]')) s(seq, applied, version, marks)")
_add("kv_conditions", lambda spark, sf: _documents(spark, sf, ("set_if_absent", "a", None, None, 1), ("set_if_present", "b", None, None, 2), ("incr", "1", None, None, 3), ("delete", None, None, None, 4), ("set_if_present", "c", None, None, 5), ("set_if_absent", "d", None, None, 6)).where("seq > 0").select("key", "seq", "applied", "value"), f"SELECT {_KEY}, s.seq, s.applied, s.value FROM customer, (VALUES (1::BIGINT, false, NULL), (2, true, 'b'), (3, false, 'b'), (4, true, NULL), (5, false, NULL), (6, true, 'd')) s(seq, applied, value) WHERE s.seq > 1 UNION ALL SELECT {_KEY}, 1, false, '{{\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\"}}' FROM customer")
_add("kv_expire", lambda spark, sf: _documents(spark, sf, ("expire", None, None, 100, 1), ("incr", "5", None, None, 50), ("incr", "5", None, None, 200), ("incr", "2", None, None, 10**9)).where("seq > 1").select("key", "seq", "applied", "version", F.when(F.col("seq") > 2, F.col("value")).alias("value")), f"SELECT {_KEY}, s.seq, s.applied, s.version, s.value FROM customer, (VALUES (2::BIGINT, false, 1::BIGINT, NULL), (3, true, 2, '5'), (4, true, 3, '7')) s(seq, applied, version, value)")
_add("stream_newest", lambda spark, sf: logs.newest(t.event_stream(spark, sf), 40, "ERROR").select("seq"), "SELECT event_id AS seq FROM events WHERE event_type = 'error' ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC LIMIT 40")


# what an empty answer can't show: the same conditions beside one that holds for some rows
for _n, _c, _sql in (("json_type_or", "json:$.type>5 OR json:$.amount>50", "value > 50"), ("json_missing_or", "json:$.nothing!=x OR json:$.type=click", "event_type = 'click'"), ("json_text_on_number_or", "json:$.amount^=1 OR json:$.type^=c", "starts_with(event_type, 'c')")):
    _add(f"job_filter_{_n}", lambda spark, sf, c=_c: records.filter_records(t.event_stream(spark, sf), c).select("seq"), f"SELECT event_id AS seq FROM events WHERE {_sql}")
_add("job_map_clears_tags_once", lambda spark, sf: _chain(spark, sf, [{"type": "classify", "rules": _RULES}, {"type": "map", "type_": "$.type", "id": "$.event_id"}, {"type": "classify", "rules": [{"condition": "json:$.type_=error", "tag": "errors"}]}], _PICKED, 1).select(F.get_json_object("value", "$.id").cast("long").alias("id")), "SELECT event_id AS id FROM events WHERE event_type = 'error'")


def _some_tagged(spark, sf_dir, low, high):
    """Points of which every second user's have another tag."""
    p = t.event_points(spark, sf_dir, low, high)
    odd = F.element_at("tags", "user").cast("long") % 2 == 1
    return p.withColumn("tags", F.when(odd, F.map_concat("tags", F.create_map(F.lit("dc"), F.lit("x")))).otherwise(F.col("tags"))).withColumn("tag_key", F.when(odd, F.concat(F.lit("dc=x,"), "tag_key")).otherwise(F.col("tag_key")))


_add("pq_tag_sometimes_equal", lambda spark, sf: run_pipe(lambda a, b: _some_tagged(spark, sf, a, b), f"click{{dc=x}}[{LOW}..{HIGH}]", HIGH), "SELECT 'click,dc=x,user=' || user_id AS series_key, 'value' AS field, epoch_us(ts) * 1000 AS ts_ns, value FROM events WHERE event_type = 'click' AND user_id % 2 = 1")
_add("pq_tag_sometimes_not_equal", lambda spark, sf: run_pipe(lambda a, b: _some_tagged(spark, sf, a, b), f"click{{dc!=x}}[{LOW}..{HIGH}]", HIGH), "SELECT 'click,user=' || user_id AS series_key, 'value' AS field, epoch_us(ts) * 1000 AS ts_ns, value FROM events WHERE event_type = 'click' AND user_id % 2 = 0")
_add("pq_topk_one", _pipe(f"click[{LOW}..{HIGH}] | topk(1)"), f"WITH {_EV} SELECT m || ',' || tag AS series_key, 'value' AS field, ts_ns, round(v, 6) AS value FROM e WHERE tag IN (SELECT tag FROM e GROUP BY tag ORDER BY sum(v) DESC, tag LIMIT 1)")
_add("pq_topk_rank", lambda spark, sf: ranking(run_pipe(lambda a, b: t.event_points(spark, sf, a, b), f"click[{LOW}..{HIGH}]", HIGH), 7).select("series_key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")), f"WITH {_EV} SELECT m || ',' || tag AS series_key, round(sum(v), 6) AS score, row_number() OVER (ORDER BY sum(v) DESC, m || ',' || tag) AS rank FROM e GROUP BY m, tag ORDER BY rank LIMIT 7")
_add("pq_alias_avg", _pipe(f"click{{user=~1*}}[{LOW}..{HIGH}] | alias(x) | window(1d) | avg()"), f"WITH {_EV}, s AS (SELECT *, min(ts_ns) OVER (PARTITION BY tag) AS o FROM e WHERE starts_with(tag, 'user=1')) SELECT 'x' AS series_key, 'value' AS field, o + (ts_ns - o) // 86400000000000 * 86400000000000 AS ts_ns, round(avg(v), 6) AS value FROM s GROUP BY tag, o, (ts_ns - o) // 86400000000000")
_add("sink_points_value_field", lambda spark, sf: _chain(spark, sf, [{"type": "passthrough"}], [{"ts": {"measurement": "m", "value_field": "amount", "tags": {"who": "$.user"}}}]).select("field", F.element_at("tags", "who").alias("who"), "pos", "value"), "SELECT 'value' AS field, 'u' || user_id AS who, event_id AS pos, value FROM events")
_add("sink_kv_keyless", lambda spark, sf: _chain(spark, sf, [{"type": "filter", "condition": "json:$.type=click"}], [{"kv": {"key_prefix": "last"}}]).select("key", F.get_json_object("value", "$.event_id").cast("long").alias("event_id")), "SELECT 'last:' AS key, arg_max(event_id, (epoch_us(ts) // 1000, event_id)) AS event_id FROM events WHERE event_type = 'click'")
_add("job_enrich_newline", lambda spark, sf: records.lookup_enrich(t.order_stream(spark, sf).withColumn("value", F.concat(F.lit(" \t"), F.to_json(F.struct(F.get_json_object("value", "$.customer").alias("c"))), F.lit(" \r\n"))), "customer:${$.c}", t.customer_kv(spark, sf).where("value LIKE '%BUILDING%'").select("key", F.concat(F.lit("\n"), F.get_json_object("value", "$.segment")).alias("value")), 'the "who"').select("seq", "value"), """SELECT o_orderkey AS seq, CASE WHEN c_custkey IS NULL THEN chr(32) || chr(9) || '{"c":"' || o_custkey || '"}' || chr(32) || chr(13) || chr(10) ELSE '{"c":"' || o_custkey || '","the \\"who\\"":"\\nBUILDING"}' END AS value FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'""")
_add("kv_json_refused", lambda spark, sf: _documents(spark, sf, ("json_set", "not json", "$.x", None, 1), ("json_set", "1", "x[", None, 2), ("json_del", None, "$.no", None, 3), ("set", "plain text", None, None, 4), ("json_set", "1", "$.x", None, 5), ("incr", "1.5", None, None, 6), ("what", "1", None, None, 7), ("json_set", "{}", "$", None, 8)).where("seq > 0").select("key", "seq", "applied", "version", F.when(F.col("seq") >= 4, F.col("value")).alias("value")), f"SELECT {_KEY}, s.seq, s.applied, s.version, s.value FROM customer, (VALUES (1::BIGINT, false, 1::BIGINT, NULL), (2, false, 1, NULL), (3, false, 1, NULL), (4, true, 2, 'plain text'), (5, false, 2, 'plain text'), (6, false, 2, 'plain text'), (7, false, 2, 'plain text'), (8, true, 3, '{{}}')) s(seq, applied, version, value)")


def _compared(spark, sf_dir):
    """Each customer: created at version 0, written at the right and at a wrong version, deleted and created again."""
    steps = [("set", "a", 0), ("set", "b", 0), ("set", "c", 1), ("incr", "1", 2), ("delete", None, 1), ("delete", None, 2), ("set", "d", 3), ("set", "e", 0)]
    ops = [F.struct(F.lit(i).cast("long").alias("seq"), F.lit(op).alias("op"), F.lit(arg).cast("string").alias("arg"), F.lit(cas).cast("long").alias("cas")) for i, (op, arg, cas) in enumerate(steps)]
    rows = t.customer_kv(spark, sf_dir).select("key", F.explode(F.array(*ops)).alias("o")).select("key", "o.*")
    return keyvalue.fold_operations(rows.withColumn("path", F.lit(None).cast("string")).withColumn("ttl_ns", F.lit(None).cast("long")).withColumn("at_ns", F.lit(0).cast("long")))


_add("kv_compare_and_set", lambda spark, sf: _compared(spark, sf).select("key", "seq", "applied", "version", "value"), f"SELECT {_KEY}, s.seq, s.applied, s.version, s.value FROM customer, (VALUES (0::BIGINT, true, 1::BIGINT, 'a'), (1, false, 1, 'a'), (2, true, 2, 'c'), (3, false, 2, 'c'), (4, false, 2, 'c'), (5, true, 3, NULL), (6, false, 3, NULL), (7, true, 4, 'e')) s(seq, applied, version, value)")


def _transfers(spark, sf_dir):
    """Every order moves an amount between two keys of its customer, both or none: odd orders end in a refused write."""
    o = t.table(spark, sf_dir, "orders")
    step = lambda i, key, op, arg: F.struct((F.col("o_orderkey") * 4 + i).alias("seq"), F.lit(key).alias("key"), F.lit(op).alias("op"), arg.cast("string").alias("arg"))
    last = F.when(F.col("o_orderkey") % 2 == 1, "set_if_absent").otherwise("set")
    ops = F.array(step(0, "from", "incr", F.lit(-1)), step(1, "to", "incr", F.lit(1)), F.struct((F.col("o_orderkey") * 4 + 2).alias("seq"), F.lit("to").alias("key"), last.alias("op"), F.lit("x").alias("arg")), step(3, "to", "delete", F.lit(None)))
    rows = o.select(F.concat(F.lit("c"), "o_custkey").alias("ns"), F.col("o_orderkey").cast("string").alias("txn"), F.explode(ops).alias("s")).select("ns", "txn", "s.*")
    return keyvalue.fold_transactions(rows.withColumn("path", F.lit(None).cast("string")).withColumn("ttl_ns", F.lit(None).cast("long")).withColumn("at_ns", F.lit(0).cast("long")))


_add("kv_transactions", lambda spark, sf: _transfers(spark, sf).where("key = 'from'").select("ns", "txn", "applied", F.col("value").cast("long").alias("value")), "SELECT 'c' || o_custkey AS ns, CAST(o_orderkey AS VARCHAR) AS txn, o_orderkey % 2 = 0 AS applied, -CAST(nullif(count(*) FILTER (o_orderkey % 2 = 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS BIGINT) AS value FROM orders")
_add("kv_history_page", lambda spark, sf: keyvalue.history_page(t.order_versions(spark, sf).where("not tombstone").withColumn("key", F.lit("all")), "all", before_version=30_000, most=20, most_bytes=100).select("version", "value"), "WITH v AS (SELECT o_orderkey + 1 AS version, CAST(o_totalprice AS VARCHAR) AS value FROM orders WHERE o_orderstatus <> 'F' ORDER BY version DESC LIMIT 64), p AS (SELECT *, sum(strlen(value)) OVER (ORDER BY version DESC) AS b, row_number() OVER (ORDER BY version DESC) AS n FROM (SELECT * FROM v WHERE version < 30000)) SELECT version, value FROM p WHERE n <= 20 AND (b <= 100 OR n = 1)")
_add("kv_json_found", lambda spark, sf: keyvalue.json_get(t.customer_kv(spark, sf), "$.segment"), "SELECT 'customer:' || c_custkey AS key, '\"' || c_mktsegment || '\"' AS found FROM customer")
_MS = "epoch_us(ts) // 1000"
_add("stream_tail", lambda spark, sf: logs.tail_stream(t.event_stream(spark, sf), 25).select("seq"), f"SELECT event_id AS seq FROM events ORDER BY {_MS} DESC, event_id DESC LIMIT 25")
_add("stream_partition", lambda spark, sf: logs.read_stream(logs.with_partition(t.event_stream(spark, sf), 4), count=None, partition=3).select("seq"), "SELECT event_id AS seq FROM events WHERE event_id % 4 = 3")
_add("stream_partitions", lambda spark, sf: logs.partition_info(logs.with_partition(t.order_stream(spark, sf), 3)).select("source", "partition", "records"), "SELECT 'orders' AS source, CAST(o_orderkey % 3 AS INTEGER) AS partition, count(*) AS records FROM orders GROUP BY 2")
_add("stream_key", lambda spark, sf: logs.read_stream(_by_type(spark, sf), count=None, key="error").select("seq"), "SELECT event_id AS seq FROM events WHERE event_type = 'error'")
_add("ts_found", lambda spark, sf: page_status(t.event_points(spark, sf), "click").unionByName(page_status(t.event_points(spark, sf), "click", "none")), "SELECT * FROM (VALUES (true), (false)) x(found)")


def _catalog(spark, sf_dir):
    """Each nation creates, creates again, alters, deletes and, if its key is odd, creates its stream once more."""
    n = t.table(spark, sf_dir, "nation")
    none = F.create_map().cast("map<string,string>")
    ops = [(1, "create", F.create_map(F.lit("keep"), F.lit("1d"), F.lit("parts"), F.lit("4"))), (2, "create", none), (3, "alter", F.create_map(F.lit("keep"), F.lit("2d"))), (4, "delete", none), (5, "alter", none)]
    steps = F.array(*[F.struct(F.lit(i).cast("long").alias("seq"), F.lit(op).alias("op"), m.cast("map<string,string>").alias("settings")) for i, op, m in ops])
    rows = n.select(F.lit("streams").alias("scope"), F.col("n_name").alias("name"), F.explode(steps).alias("o")).select("scope", "name", "o.*")
    again = n.where("n_nationkey % 2 = 1").select(F.lit("streams").alias("scope"), F.col("n_name").alias("name"), F.lit(6).cast("long").alias("seq"), F.lit("create").alias("op"), F.create_map(F.lit("parts"), F.lit("1")).cast("map<string,string>").alias("settings"))
    return rows.unionByName(again)


_add("catalog_fold", lambda spark, sf: fold_catalog(_catalog(spark, sf)).where("seq < 6").select("name", "seq", "applied", "exists", F.element_at("settings", F.lit("keep")).alias("keep"), F.element_at("settings", F.lit("parts")).alias("parts")), "SELECT n_name AS name, s.* FROM nation, (VALUES (1::BIGINT, true, true, '1d', '4'), (2, false, true, '1d', '4'), (3, true, true, '2d', '4'), (4, true, false, NULL, NULL), (5, false, false, NULL, NULL)) s(seq, applied, exists, keep, parts)")
_add("catalog_current", lambda spark, sf: current_catalog(_catalog(spark, sf)).select("name", F.element_at("settings", F.lit("keep")).alias("keep"), F.element_at("settings", F.lit("parts")).alias("parts")), "SELECT n_name AS name, CAST(NULL AS VARCHAR) AS keep, '1' AS parts FROM nation WHERE n_nationkey % 2 = 1")
_add("ts_late_points", lambda spark, sf: mark_late(t.lineitem_points(spark, sf), 86_400_000).groupBy("field").agg(F.count_if("late").alias("late"), F.count(F.lit(1)).alias("points")), "WITH p AS (SELECT epoch_us(l_shipdate) AS us, max(epoch_us(l_shipdate)) OVER (ORDER BY l_orderkey * 8 + l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM lineitem) SELECT f.field, count(*) FILTER (newest - us > 86400000000) AS late, count(*) AS points FROM p, (VALUES ('quantity'), ('extendedprice'), ('discount'), ('tax')) f(field) GROUP BY f.field")


_add("ts_dashboard", lambda spark, sf: dashboard_page(t.event_points(spark, sf), "click", "1h", "avg", limit=50), f"WITH {_EV} SELECT 'click' AS measurement, '1h' AS window, 'avg' AS aggregation, ts_ns, pos, v AS value FROM e ORDER BY ts_ns, pos LIMIT 50")
_add("names_page", lambda spark, sf: names_page(t.customer_kv(spark, sf), "key", "customer:12", "customer:1", 30), "SELECT DISTINCT 'customer:' || c_custkey AS name FROM customer WHERE CAST(c_custkey AS VARCHAR) LIKE '1%' AND 'customer:' || c_custkey > 'customer:12' ORDER BY name LIMIT 30")
# Its SQL takes every click, so the scan has no limit; the answer, at most 31 days, has the server's.
_add("pq_strict", lambda spark, sf: run_pipe(lambda a, b: t.event_points(spark, sf, a, b), f"click[{LOW}..{HIGH}] | window(1d) | sum()", HIGH, True, True, most_scanned=None).withColumn("value", F.round("value", 6)), f"WITH {_EV}, s AS (SELECT *, min(ts_ns) OVER () AS o FROM e) SELECT 'click' AS series_key, 'value' AS field, o + (ts_ns - o) // 86400000000000 * 86400000000000 AS ts_ns, round(sum(v), 6) AS value FROM s GROUP BY o, (ts_ns - o) // 86400000000000")
_add("job_time_window", lambda spark, sf: event_time.window_aggregate(_by_type(spark, sf), "sum", "$.amount", 3_600_000).select("key", "start_ms", F.round("value", 4).alias("value"), "count"), f"SELECT event_type AS key, {_MS} // 3600000 * 3600000 AS start_ms, round(sum(value), 4) AS value, count(*) AS count FROM events GROUP BY ALL")
_add("job_sliding_window", lambda spark, sf: event_time.window_aggregate(_by_type(spark, sf), "max", "$.amount", 7_200_000, 3_600_000).select("key", "start_ms", "end_ms", "value"), f"WITH e AS (SELECT *, {_MS} // 3600000 * 3600000 AS h FROM events), w AS (SELECT event_type, h AS s, value FROM e UNION ALL SELECT event_type, h - 3600000, value FROM e) SELECT event_type AS key, s AS start_ms, s + 7200000 AS end_ms, max(value) AS value FROM w GROUP BY event_type, s")
_add("job_session", lambda spark, sf: event_time.session_aggregate(records.key_by(t.event_stream(spark, sf), "$.user"), "count", None, 6 * 3_600_000).select("key", "start_ms", "end_ms", "count"), f"WITH e AS (SELECT *, {_MS} AS ms FROM events), g AS (SELECT *, coalesce(ms - lag(ms) OVER w >= 21600000, true) AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)), n AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS s FROM g) SELECT 'u' || user_id AS key, min(ms) AS start_ms, max(ms) + 21600000 AS end_ms, count(*) AS count FROM n GROUP BY user_id, s")
_add("job_dedup", lambda spark, sf: event_time.dedup(records.key_by(t.event_stream(spark, sf), "$.user"), ["key"]).select("key", "seq"), f"SELECT 'u' || user_id AS key, arg_min(event_id, ({_MS}, event_id)) AS seq FROM events GROUP BY user_id")


def _clicks_and_errors(spark, sf_dir):
    ev = records.key_by(t.event_stream(spark, sf_dir), "$.user")
    kind = F.get_json_object("value", "$.type")
    return event_time.join_within(ev.where(kind == "click"), ev.where(kind == "error"), 3_600_000, width_ms=10_000_000).select("key", "left_seq", "right_seq")


_add("job_join_within", _clicks_and_errors, f"WITH e AS (SELECT *, {_MS} AS ms FROM events) SELECT 'u' || a.user_id AS key, a.event_id AS left_seq, b.event_id AS right_seq FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'error' AND abs(a.ms - b.ms) <= 3600000")
_add("job_quiet_keys", lambda spark, sf: event_time.quiet_keys(records.key_by(t.event_stream(spark, sf), "$.user"), 86_400_000, HIGH).select("key", "last_ms", "quiet_ms"), f"WITH e AS (SELECT user_id, {_MS} AS ms, lead({_MS}, 1, {HIGH}) OVER (PARTITION BY user_id ORDER BY {_MS}, event_id) AS nxt FROM events) SELECT 'u' || user_id AS key, ms AS last_ms, nxt - ms AS quiet_ms FROM e WHERE nxt - ms >= 86400000")
