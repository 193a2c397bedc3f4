"""Registered queries over the given tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keyvalue, logs, points, records
from ..operators.series import run_pipe
from ..sources import tables as t
from ..sources.line_protocol import parse_lines

LOW, HIGH = 1704067200000, 1706745600000
_EV = "e AS (SELECT event_type AS m, 'user=' || user_id AS tag, epoch_us(ts) * 1000 AS ts_ns, event_id AS pos, value AS v FROM events)"
QUERIES, ORACLES = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _pipe(text, merged=False, source=t.event_points):
    def query(spark, sf_dir):
        out = run_pipe(lambda a, b: source(spark, sf_dir, a, b), text, HIGH, merged)
        return out.withColumn("value", F.round("value", 6))

    return query


def _series(key="m", sel="ts_ns, v AS value", where="", body="s"):
    return f"WITH {_EV}, s AS (SELECT {key} AS series_key, ts_ns, pos, v, m, tag FROM e WHERE m = 'click' {where}) SELECT series_key, 'value' AS field, {sel} FROM {body}"


_R = f"[{LOW}..{HIGH}]"
_TAGGED = "m || ',' || tag"
for _a in ("avg", "sum", "count", "min", "max"):
    for _mode, _key in (("", "m"), ("_tagged", _TAGGED)):
        _w = 3_600_000_000_000 if not _mode else 86_400_000_000_000
        _body = f"(SELECT *, min(ts_ns) OVER (PARTITION BY series_key) AS o FROM s) GROUP BY series_key, o, (ts_ns - o) // {_w}"
        _sel = f"o + ((ts_ns - o) // {_w}) * {_w} AS ts_ns, round(CAST({_a}(v) AS DOUBLE), 6) AS value"
        _add(f"pq_window_{_a}{_mode}", _pipe(f"click{_R} | window({'1h' if not _mode else '1d'}) | {_a}()", not _mode), _series(_key, _sel, body=_body))
_w = 3_600_000_000_000
_body = f"(SELECT *, min(ts_ns) OVER (PARTITION BY series_key) AS o FROM s) GROUP BY series_key, o, (ts_ns - o) // {_w}"
_add("pq_percentile_95", _pipe(f"click{_R} | window(1h) | percentile(95)", True), _series("m", f"o + ((ts_ns - o) // {_w}) * {_w} AS ts_ns, round(quantile_cont(v, 0.95), 6) AS value", body=_body))
_lag = "(SELECT *, lag(v) OVER w AS v0, lag(ts_ns) OVER w AS t0 FROM s WINDOW w AS (PARTITION BY series_key ORDER BY ts_ns, pos))"
_add("pq_rate", _pipe(f"click{_R} | rate(1m)"), _series(_TAGGED, "ts_ns, round((CASE WHEN v < v0 THEN v ELSE v - v0 END) / ((ts_ns - t0) / 1e9), 6) AS value", body=_lag + " WHERE ts_ns > t0"))
_add("pq_delta", _pipe(f"click{_R} | delta()"), _series(_TAGGED, "ts_ns, round(v - v0, 6) AS value", body=_lag + " WHERE t0 IS NOT NULL"))
for _n, _stage, _sql in (
    ("abs", "math(- 50) | abs()", "abs(v - 50)"), ("ceil", "ceil()", "ceil(v)"), ("floor", "floor()", "floor(v)"), ("round", "round(1)", "round(v * 10) / 10"),
    ("math_mul", "math(value * 100)", "v * 100"), ("math_div", "math(/ 4)", "v / 4"), ("math_div_zero", "math(/ 0)", "v"), ("math_mod", "math(- 50) | math(% 7)", "fmod(fmod(v - 50, 7) + 7, 7)"), ("math_add", "math(+ 1.5)", "v + 1.5"),
):
    _add(f"pq_{_n}", _pipe(f"click{_R} | {_stage}"), _series(_TAGGED, f"ts_ns, round(CAST({_sql} AS DOUBLE), 6) AS value"))
_add("pq_where", _pipe(f"click{_R} | where(value >= 40)"), _series(_TAGGED, "ts_ns, round(v, 6) AS value", "AND v >= 40"))
_add("pq_alias", _pipe(f"click{_R} | alias(clicks)"), _series("'clicks'", "ts_ns, round(v, 6) AS value"))
for _n, _f in (("first", "arg_min"), ("last", "arg_max")):
    _add(f"pq_{_n}", _pipe(f"click{_R} | {_n}()"), _series(_TAGGED, f"{_f}(ts_ns, (ts_ns, pos)) AS ts_ns, round({_f}(v, (ts_ns, pos)), 6) AS value", body="s GROUP BY series_key"))
for _n, _d in (("topk", "DESC"), ("bottomk", "ASC")):
    _body = f"s WHERE series_key IN (SELECT series_key FROM s GROUP BY series_key ORDER BY sum(v) {_d}, series_key LIMIT 5)"
    _add(f"pq_{_n}", _pipe(f"click{_R} | {_n}(5)"), _series(_TAGGED, "ts_ns, round(v, 6) AS value", body=_body))
_add("pq_group_by", _pipe("lineitem[0..2000000000000] | field(quantity) | group_by(flag)", source=t.lineitem_points), "SELECT 'lineitem,flag=' || l_returnflag AS series_key, 'quantity' AS field, epoch_us(l_shipdate) * 1000 AS ts_ns, round(l_quantity, 6) AS value FROM lineitem")
_add("pq_group_by_untagged", _pipe(f"click{_R} | group_by(nothing)"), _series("'click,nothing=_untagged_'", "ts_ns, round(v, 6) AS value"))
for _n, _q, _where in (
    ("glob", "user=~1?", "AND regexp_full_match(tag, 'user=1.')"), ("not_glob", "user!~1*", "AND NOT starts_with(tag, 'user=1')"), ("equal", "user=7", "AND tag = 'user=7'"), ("not_equal", "user!=7", "AND tag <> 'user=7'"),
    ("absent_not_equal", "dc!=x", ""), ("absent_equal", "dc=x", "AND false"), ("two_tags", "user=~1*,user!=12", "AND starts_with(tag, 'user=1') AND tag <> 'user=12'"),
):
    _add(f"pq_tag_{_n}", _pipe(f"click{{{_q}}}{_R}"), _series(_TAGGED, "ts_ns, round(v, 6) AS value", _where))
_add("pq_range_back", _pipe("click[20d..10d]"), _series(_TAGGED, "ts_ns, round(v, 6) AS value", f"AND ts_ns BETWEEN {(HIGH - 20 * 86400000) * 1000000} AND {(HIGH - 10 * 86400000) * 1000000}"))
_add("pq_full_pipe", _pipe(f"click{{user=~1*}}{_R} | window(1d) | avg() | math(value * 100) | round(1)", True), "WITH " + _EV + ", s AS (SELECT *, min(ts_ns) OVER () AS o FROM e WHERE m = 'click' AND starts_with(tag, 'user=1')) SELECT 'click' AS series_key, 'value' AS field, o + ((ts_ns - o) // 86400000000000) * 86400000000000 AS ts_ns, round(round(avg(v) * 100 * 10) / 10, 6) AS value FROM s GROUP BY o, (ts_ns - o) // 86400000000000")

for _a in ("avg", "sum", "count", "min", "max"):
    _add(f"ts_query_{_a}", lambda spark, sf, a=_a: points.bucket_query(t.event_points(spark, sf), "click", agg=a, window_ns=3_600_000_000_000).withColumn("value", F.round("value", 6)), f"WITH {_EV} SELECT m AS measurement, ts_ns - ts_ns % 3600000000000 AS start_ns, round(CAST({_a}(v) AS DOUBLE), 6) AS value FROM e WHERE m = 'click' GROUP BY ALL")
_add("ts_read_page", lambda spark, sf: points.read_page(t.event_points(spark, sf), "click", low_ns=LOW * 1_000_000, limit=500, after=(1705000000000000000, 0)), f"WITH {_EV} SELECT ts_ns, pos, v AS value FROM e WHERE m = 'click' AND (ts_ns, pos) > (1705000000000000000, 0) ORDER BY ts_ns, pos LIMIT 500")
_add("ts_read_reverse", lambda spark, sf: points.read_page(t.lineitem_points(spark, sf), "lineitem", "tax", {"flag": "A"}, limit=200, descending=True), "SELECT epoch_us(l_shipdate) * 1000 AS ts_ns, l_orderkey * 8 + l_linenumber AS pos, l_tax AS value FROM lineitem WHERE l_returnflag = 'A' ORDER BY ts_ns DESC, pos DESC LIMIT 200")
_add("ts_list", lambda spark, sf: points.list_measurements(t.event_points(spark, sf)), f"WITH {_EV} SELECT m AS measurement, count(DISTINCT tag) AS series, CAST(1 AS BIGINT) AS fields, count(*) AS points FROM e GROUP BY m")
_add("ts_info", lambda spark, sf: points.measurement_info(t.lineitem_points(spark, sf), "lineitem"), "SELECT count(DISTINCT (l_returnflag, l_linestatus)) AS series, 'discount,extendedprice,quantity,tax' AS fields, count(*) * 4 AS points, min(epoch_us(l_shipdate)) * 1000 AS oldest_ns, max(epoch_us(l_shipdate)) * 1000 AS newest_ns FROM lineitem")
_add("ts_summary", lambda spark, sf: points.summary(t.event_points(spark, sf), "click").select(F.round("avg", 6).alias("avg"), "min", "max", F.round("sum", 4).alias("sum"), "count"), "SELECT round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum, count(*) AS count FROM events WHERE event_type = 'click'")
_add("ts_retention", lambda spark, sf: points.retain(t.event_points(spark, sf), HIGH * 1_000_000, 10 * 86_400_000_000_000).select("measurement", "ts_ns", "pos", "value"), f"WITH {_EV} SELECT m AS measurement, ts_ns, pos, v AS value FROM e WHERE ts_ns >= {HIGH * 1_000_000 - 10 * 86_400_000_000_000}")
_add("ts_delete", lambda spark, sf: points.delete_series(t.event_points(spark, sf), "click", {"user": "7"}).groupBy("measurement").agg(F.count(F.lit(1)).alias("n")), "SELECT event_type AS measurement, count(*) AS n FROM events WHERE NOT (event_type = 'click' AND user_id = 7) GROUP BY 1")
_late = ", ".join(f"count(*) FILTER (behind > {e * 1_000_000}) AS late_{e}" for e in points.LATE_EDGES_MS)
_add("ts_late_histogram", lambda spark, sf: points.late_histogram(t.lineitem_points(spark, sf)), f"WITH p AS (SELECT epoch_us(l_shipdate) * 1000 AS ts_ns, l_orderkey * 8 + l_linenumber AS pos FROM lineitem), b AS (SELECT max(ts_ns) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - ts_ns AS behind FROM p) SELECT 'lineitem' AS measurement, f.field, {_late} FROM b, (VALUES ('quantity'), ('extendedprice'), ('discount'), ('tax')) f(field) GROUP BY f.field")


def _lines(spark, sf_dir):
    ev = t.table(spark, sf_dir, "events")
    bad = F.when(F.col("event_id") % 10 == 3, F.lit(' f="text"')).when(F.col("event_id") % 10 == 4, F.lit(" f=1,f=2")).otherwise(F.concat(F.lit(" value="), F.col("value"), F.lit(",n="), F.col("user_id"), F.lit("i "), F.floor(t.micros("ts") / 1000)))
    return ev.select(F.col("event_id").alias("line_no"), F.concat("event_type", F.lit(",user="), "user_id", bad).alias("text"))


_add("ts_line_protocol", lambda spark, sf: parse_lines(_lines(spark, sf))[0].select("measurement", "field", "tag_key", "ts_ns", "pos", "value"), "WITH g AS (SELECT * FROM events WHERE event_id % 10 NOT IN (3, 4)) SELECT event_type AS measurement, f.field AS field, 'user=' || user_id AS tag_key, epoch_us(ts) // 1000 * 1000000 AS ts_ns, event_id AS pos, CASE f.field WHEN 'value' THEN value ELSE CAST(user_id AS DOUBLE) END AS value FROM g, (VALUES ('value'), ('n')) AS f(field)")
_add("ts_line_protocol_errors", lambda spark, sf: parse_lines(_lines(spark, sf))[1], "SELECT event_id AS line_no, CASE event_id % 10 WHEN 3 THEN 'field is not a number' ELSE 'duplicate field' END AS message FROM events WHERE event_id % 10 IN (3, 4)")

_seq = lambda df: df.select("seq")
for _n, _c, _sql in (
    ("json_number", "json:$.amount>50", "value > 50"), ("json_string", "json:$.type=click", "event_type = 'click'"), ("json_not", "json:type!=click", "event_type <> 'click'"), ("json_bool", "json:$.large=true", "value > 50"),
    ("json_type", "json:$.type>5", "false"), ("json_missing", "json:$.nothing!=x", "false"), ("json_prefix", "json:$.user^=u1", "CAST(user_id AS VARCHAR) LIKE '1%'"), ("and", 'value_contains:"click" AND json:$.amount<=20', "event_type = 'click' AND value <= 20"),
    ("or", "json:$.type=click OR json:$.amount>90", "event_type = 'click' OR value > 90"),
):
    _add(f"job_filter_{_n}", lambda spark, sf, c=_c: _seq(records.filter_records(t.event_stream(spark, sf), c)), f"SELECT event_id AS seq FROM events WHERE {_sql}")
_add("job_filter_text", lambda spark, sf: _seq(records.filter_records(t.document_stream(spark, sf), "value_contains:the AND min_length:500")), "SELECT doc_id AS seq FROM documents WHERE contains(text, 'the') AND strlen(text) >= 500")
_add("job_map", lambda spark, sf: records.map_records(t.event_stream(spark, sf), {"who": "$.user", "no": "$.missing", "big": "$.large", "from": "web"}).select("seq", "value"), """SELECT event_id AS seq, '{"who":"u' || user_id || '","no":null,"big":' || (value > 50) || ',"from":"web"}' AS value FROM events""")
_add("job_keyby", lambda spark, sf: records.key_by(t.order_stream(spark, sf), "$.customer").groupBy("key").agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS n FROM orders GROUP BY 1")
_add("job_keyby_float_keeps", lambda spark, sf: records.key_by(t.event_stream(spark, sf), "$.user").transform(lambda d: records.key_by(d, "$.nothing")).select("seq", "key"), "SELECT event_id AS seq, 'u' || user_id AS key FROM events")
_add("job_flatmap", lambda spark, sf: records.flat_map(t.nested_order_stream(spark, sf), "$.items", "line").select("seq", "key", "value"), """SELECT o_orderkey AS seq, CAST(l_linenumber AS VARCHAR) AS key, '{"line":' || l_linenumber || ',"part":"' || l_partkey || '","quantity":' || CAST(l_quantity AS BIGINT) || '}' AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
_RULES = [("json:$.type=error", "errors"), ("json:$.amount>80", "high"), ("json:$.large=true", "large")]
_add("job_classify", lambda spark, sf: records.classify(t.event_stream(spark, sf), _RULES, "other").select("seq", F.array_join("tags", ",").alias("tags")), "SELECT event_id AS seq, coalesce(nullif(concat_ws(',', CASE WHEN event_type = 'error' THEN 'errors' END, CASE WHEN value > 80 THEN 'high' END, CASE WHEN value > 50 THEN 'large' END), ''), 'other') AS tags FROM events")
_add("job_route", lambda spark, sf: _seq(records.route(records.classify(t.event_stream(spark, sf), _RULES), ["errors", "large"])), "SELECT event_id AS seq FROM events WHERE event_type = 'error' AND value > 50")
for _a in records.FUNCTIONS:
    _over = f"{_a}(value) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id ROWS UNBOUNDED PRECEDING)"
    _add(f"job_running_{_a}", lambda spark, sf, a=_a: records.running_aggregate(records.key_by(t.event_stream(spark, sf), "$.type"), a, "$.amount").select("seq", "key", F.round("value", 8 if a == "avg" else 4).alias("value"), "count"), f"SELECT event_id AS seq, event_type AS key, round(CAST({_over} AS DOUBLE), {8 if _a == 'avg' else 4}) AS value, {_over.replace(_a + '(', 'count(', 1)} AS count FROM events")
    _add(f"job_count_window_{_a}", lambda spark, sf, a=_a: records.count_window_aggregate(records.key_by(t.event_stream(spark, sf), "$.type"), a, 7, "$.amount").select("key", "seq", F.round("value", 6).alias("value"), "count"), f"WITH r AS (SELECT *, epoch_us(ts) // 1000 AS ms, (row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) - 1) // 7 AS w FROM events) SELECT event_type AS key, arg_max(event_id, (ms, event_id)) AS seq, round(CAST({_a}(value) AS DOUBLE), 6) AS value, count(*) AS count FROM r GROUP BY event_type, w HAVING count(*) = 7")
_add("job_aggregate_json", lambda spark, sf: records.aggregate_json(records.running_aggregate(records.key_by(t.event_stream(spark, sf), "$.type"), "count")).select("seq", "value"), """SELECT event_id AS seq, '{"key":"' || event_type || '","value":' || n || ',"count":' || n || '}' AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events)""")
_live = lambda spark, sf: t.customer_kv(spark, sf).where("value LIKE '%BUILDING%'")
_add("job_kv_lookup_filter", lambda spark, sf: _seq(records.lookup_filter(t.order_stream(spark, sf), "customer:${$.customer}", _live(spark, sf))), "SELECT o_orderkey AS seq FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
_add("job_kv_lookup_enrich", lambda spark, sf: records.lookup_enrich(t.order_stream(spark, sf).withColumn("value", F.to_json(F.struct(F.get_json_object("value", "$.customer").alias("customer")))), "customer:${$.customer}", _live(spark, sf), "who").select("seq", "value"), """SELECT o_orderkey AS seq, CASE WHEN c_custkey IS NULL THEN '{"customer":"' || o_custkey || '"}' ELSE '{"customer":"' || o_custkey || '","who":{"name":"' || c_name || '","segment":"BUILDING"}}' END AS value FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'""")
_add("job_union_sources", lambda spark, sf: t.event_stream(spark, sf).unionByName(t.order_stream(spark, sf)).groupBy("source").agg(F.count(F.lit(1)).alias("n")), "SELECT 'events' AS source, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders")
_add("sink_kv", lambda spark, sf: logs.sink_kv(records.key_by(t.order_stream(spark, sf), "$.customer"), "c").select("key", F.get_json_object("value", "$.order").cast("long").alias("last_order")), "SELECT 'c:' || o_custkey AS key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey")
_add("sink_points", lambda spark, sf: logs.sink_points(t.event_stream(spark, sf), "m", {"amount": "$.amount", "type": "$.type"}, {"user": "$.user"}).select("field", F.element_at("tags", "user").alias("user"), "pos", "value"), "SELECT 'amount' AS field, 'u' || user_id AS user, event_id AS pos, value FROM events")
_add("sink_queue", lambda spark, sf: logs.sink_queue(t.order_stream(spark, sf), 3).groupBy("priority").agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(3 AS INTEGER) AS priority, count(*) AS n FROM orders")

_add("stream_read", lambda spark, sf: logs.read_stream(t.order_stream(spark, sf), (900000000000, 0), None, 100).select("ts_ms", "seq"), "SELECT epoch_us(o_orderdate) // 1000 AS ts_ms, o_orderkey AS seq FROM orders WHERE epoch_us(o_orderdate) // 1000 > 900000000000 OR (epoch_us(o_orderdate) // 1000 = 900000000000 AND o_orderkey > 0) ORDER BY 1, 2 LIMIT 100")
_add("stream_info", lambda spark, sf: logs.stream_info(t.document_stream(spark, sf)), "SELECT 'documents' AS source, count(*) AS records, CAST(sum(strlen(text)) AS BIGINT) AS bytes, min(doc_id) AS first_ms, min(doc_id) AS first_seq, max(doc_id) AS last_ms, max(doc_id) AS last_seq FROM documents")
_add("stream_trim_newest", lambda spark, sf: logs.trim(t.event_stream(spark, sf), newest=50).select("seq"), "SELECT event_id AS seq FROM events ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC LIMIT 50")
_add("stream_trim_before", lambda spark, sf: logs.trim(t.event_stream(spark, sf), before_ms=1705000000000).select("seq"), "SELECT event_id AS seq FROM events WHERE epoch_us(ts) // 1000 >= 1705000000000")
_add("queue_peek", lambda spark, sf: logs.ready(t.order_queue(spark, sf), 900000000000000000, 100), "SELECT 'orders' AS queue, o_orderkey AS seq, CAST(left(o_orderpriority, 1) AS INTEGER) AS priority, epoch_us(o_orderdate) * 1000 AS due_ns FROM orders WHERE o_orderstatus = 'O' AND epoch_us(o_orderdate) * 1000 <= 900000000000000000 ORDER BY 3, 4, 2 LIMIT 100")
_add("queue_stats", lambda spark, sf: logs.queue_stats(t.order_queue(spark, sf)), "SELECT 'orders' AS queue, count(*) FILTER (o_orderstatus = 'O') AS ready, count(*) FILTER (o_orderstatus = 'P') AS leased, count(*) FILTER (o_orderstatus NOT IN ('O', 'P')) AS dead FROM orders")
_V = "v AS (SELECT 'customer:' || o_custkey AS key, o_orderkey + 1 AS version, CAST(o_totalprice AS VARCHAR) AS value, o_orderstatus = 'F' AS tombstone FROM orders)"
_add("kv_current", lambda spark, sf: keyvalue.current(t.order_versions(spark, sf)).select("key", "version", F.col("value").cast("double").alias("value")), f"WITH {_V} SELECT key, version, CAST(value AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS n FROM v) WHERE n = 1 AND NOT tombstone")
_add("kv_history", lambda spark, sf: keyvalue.history(t.order_versions(spark, sf), 8).select("key", "version", "tombstone", "rank"), f"WITH {_V}, r AS (SELECT *, row_number() OVER w AS rank, coalesce(sum(CAST(tombstone AS INTEGER)) OVER (PARTITION BY key ORDER BY version DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM v WINDOW w AS (PARTITION BY key ORDER BY version DESC)) SELECT key, version, tombstone, rank FROM r WHERE rank <= 8 AND d = 0")
_add("kv_prefix_scan", lambda spark, sf: keyvalue.prefix_scan(t.customer_kv(spark, sf), "customer:1", "customer:10", 200), "SELECT 'customer:' || c_custkey AS key FROM customer WHERE CAST(c_custkey AS VARCHAR) LIKE '1%' AND 'customer:' || c_custkey > 'customer:10' ORDER BY key LIMIT 200")
_add("kv_mget", lambda spark, sf: keyvalue.multi_get(t.customer_kv(spark, sf), ["customer:5", "customer:none", "customer:1"]).select("ask", "key", "found"), "SELECT * FROM (VALUES (0::BIGINT, 'customer:5', true), (1, 'customer:none', false), (2, 'customer:1', true)) AS x(ask, key, found)")
_add("kv_json_get", lambda spark, sf: t.customer_kv(spark, sf).select("key", F.expr("try_variant_get(try_parse_json(value), \"$['segment']\", 'string')").alias("segment")), "SELECT 'customer:' || c_custkey AS key, c_mktsegment AS segment FROM customer")


def _counter_ops(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    return o.select(F.concat(F.lit("spent:"), "o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "P", "delete").otherwise("incr").alias("op"), F.floor("o_totalprice").cast("string").alias("arg"), none.alias("path"), F.lit(None).cast("long").alias("ttl_ns"), F.lit(0).cast("long").alias("at_ns"))


_add("kv_counter_fold", lambda spark, sf: keyvalue.fold_operations(_counter_ops(spark, sf)).where("op = 'incr'").select("key", "seq", F.col("value").cast("long").alias("value")), "WITH g AS (SELECT *, count(*) FILTER (o_orderstatus = 'P') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS part FROM orders) SELECT 'spent:' || o_custkey AS key, o_orderkey AS seq, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey, part ORDER BY o_orderkey) AS BIGINT) AS value FROM g WHERE o_orderstatus <> 'P'")
