import json

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import keyvalue, logs, records
from tarnflow.operators.conditions import ConditionError, condition
from tarnflow.plans.job_definition import JobError, parse_job
from tarnflow.streaming.runner import points_as_records, run_chain, start_job, to_sinks

RECORD = "source string, key string, value string, event_time_ms long, tags array<string>, ts_ms long, seq long"


def stream(spark, values, keys=None, source="s"):
    return spark.createDataFrame([(source, keys[i] if keys else "", v, i, [], i, i) for i, v in enumerate(values)], RECORD)


def values(df):
    return [r.value for r in df.orderBy("ts_ms", "seq").collect()]


@pytest.mark.parametrize(
    ("doc", "eq", "ne", "gt", "prefix"),
    [('{"a":5}', 1, 0, 1, 0), ('{"a":5.0}', 1, 0, 1, 0), ('{"a":"5"}', 1, 0, 0, 1), ('{"a":true}', 0, 0, 0, 0), ('{"a":null}', 0, 0, 0, 0), ("{}", 0, 0, 0, 0), ("nope", 0, 0, 0, 0), ('{"a":1,"a":5}', 0, 0, 0, 0), ('{"a":[5]}', 0, 0, 0, 0)],
)
def test_json_compare_by_type(spark, doc, eq, ne, gt, prefix):
    df = stream(spark, [doc])
    got = df.select(*[condition(f"json:a{c}").cast("int") for c in ("=5", "!=5", ">4", "^=5")]).first()
    assert tuple(got) == (eq, ne, gt, prefix)


def test_conditions(spark):
    v = ["payment approved", "payment pending", "refund approved", "kyc"]
    df = stream(spark, v, ["k1", "k2", "", "x"])
    pick = lambda c: values(records.filter_records(df, c))
    assert pick("value_contains:payment AND value_contains:approved") == v[:1]
    assert pick("value_contains:refund OR value_contains:kyc") == v[2:]
    assert pick("key_prefix:k") == v[:2] and pick("key_equals:x") == v[3:] and pick("key_not_empty") == [v[0], v[1], v[3]] and pick("min_length:4") == v[:3]
    for bad in ("", "nonsense", "min_length:x", "a AND b OR c", "json:=5", " AND ".join(["not_empty"] * 9)):
        with pytest.raises(ConditionError):
            condition(bad)


def test_map_keyby_flatmap(spark):
    df = stream(spark, ['{"user_id":"alice","age":30,"tags":["hello","w"]}', "not json", '{"items":[1,2,3]}', '{"items":"x"}', '{"items":[]}'])
    assert values(records.map_records(df, {"user": "$.user_id", "n": "$.age", "x": 'a"b', "gone": "$.no"}))[0] == '{"user":"alice","n":30,"x":"a\\"b","gone":null}'
    assert len(values(records.map_records(df, {"user": "$.user_id"}))) == 4
    assert values(records.flat_map(df, "$.items")) == ["1", "2", "3"]
    assert values(records.flat_map(df, "$.tags")) == ['"hello"', '"w"']
    keys = [r.key for r in records.key_by(stream(spark, ['{"k":"a"}', '{"k":7}', '{"k":1.5}', '{"k":true}', '{"k":null}', "x"], list("zzzzzz")), "$.k").orderBy("seq").collect()]
    assert keys == ["a", "7", "z", "true", "z", "z"]


def test_classify_and_route(spark):
    df = records.classify(stream(spark, ["info: all good", "error: minor glitch", "critical error: system down"]), [("value_contains:error", "errors"), ("value_contains:critical", "critical")], "other")
    assert [len(values(records.route(df, t))) for t in ([], ["errors"], ["critical", "errors"], ["other"], ["unknown"])] == [3, 2, 1, 1, 0]


def test_aggregates(spark):
    df = stream(spark, ['{"amount":10}', '{"amount":25.5}', '{"amount":"x"}', "no", '{"amount":1}'], ["k1", "k1", "k1", "k1", "k2"])
    got = [(r.key, r.value, r["count"]) for r in records.running_aggregate(df, "sum", "$.amount").orderBy("seq").collect()]
    assert got == [("k1", 10.0, 1), ("k1", 35.5, 2), ("k2", 1.0, 1)]
    assert values(records.aggregate_json(records.running_aggregate(df, "sum", "$.amount")))[:2] == ['{"key":"k1","value":10,"count":1}', '{"key":"k1","value":35.5,"count":2}']
    four = stream(spark, ['{"a":1}'] * 5)
    assert [(r.value, r["count"]) for r in records.count_window_aggregate(four, "count", 2).collect()] == [(2.0, 2), (2.0, 2)]


def test_lookups(spark):
    kv = spark.createDataFrame([("account:alice", "x"), ("account:bob", '{"t":1}')], "key string, value string")
    df = stream(spark, ['{"id":"alice"}', '{"id":"charlie"}', '{"id":"bob"}', '{"id":5}', "no"])
    assert len(values(records.lookup_filter(df, "account:${$.id}", kv))) == 2
    spaced = stream(spark, ['{"id":"alice"}\n', ' \t{"id":"bob" } \r\n'])
    assert values(records.lookup_enrich(spaced, "account:${$.id}", kv, 'a"b')) == ['{"id":"alice","a\\"b":"x"}', '{"id":"bob" ,"a\\"b":{"t":1}}']
    assert values(records.lookup_enrich(df, "account:${$.id}", kv, "tier")) == ['{"id":"alice","tier":"x"}', '{"id":"charlie"}', '{"id":"bob","tier":{"t":1}}', '{"id":5}', "no"]


def test_point_sink(spark):
    df = stream(spark, ['{"host":"a","cpu":72.5}', '{"host":5,"cpu":85.3}', '{"cpu":"x"}', "1.5"])
    got = logs.sink_points(df, "m", {"cpu": "$.cpu"}, {"host": "$.host"}).orderBy("pos").collect()
    assert [(r.tags, r.value) for r in got] == [({"host": "a"}, 72.5), ({}, 85.3)]
    assert [r.value for r in logs.sink_points(df, "m").collect()] == [1.5]
    assert [(r.field, r.value) for r in logs.sink_points(df, "m", value_field="cpu").orderBy("pos").collect()] == [("value", 72.5), ("value", 85.3), ("value", 1.5)]


def test_kv_fold(spark):
    ops = [("a", "set", "x", None, None, 0), ("a", "set_if_absent", "y", None, None, 1), ("a", "incr", "1", None, None, 2), ("a", "delete", None, None, None, 3), ("a", "incr", "5", None, None, 4), ("a", "incr", "2", None, None, 5), ("b", "set", '{"p":[{"c":1}]}', None, 10, 0), ("b", "json_set", "2", "$.p[0].c", None, 5), ("b", "incr", "1", None, None, 6), ("b", "json_del", None, "$.p[0]", None, 7), ("b", "expire", None, None, 1, 8), ("b", "incr", "3", None, None, 20)]
    df = spark.createDataFrame([(k, i, op, a, p, ttl, at) for i, (k, op, a, p, ttl, at) in enumerate(ops)], "key string, seq long, op string, arg string, path string, ttl_ns long, at_ns long")
    got = {r.seq: (r.applied, r.version, r.value) for r in keyvalue.fold_operations(df).collect()}
    assert [got[i] for i in range(6)] == [(True, 1, "x"), (False, 1, "x"), (False, 1, "x"), (True, 2, None), (True, 3, "5"), (True, 4, "7")]
    assert [got[i] for i in range(6, 12)] == [(True, 1, '{"p":[{"c":1}]}'), (True, 2, '{"p":[{"c":2}]}'), (False, 2, '{"p":[{"c":2}]}'), (True, 3, '{"p":[]}'), (True, 3, '{"p":[]}'), (True, 4, "3")]


JOB = {"kind": "Processing", "name": "j", "sources": [{"stream": {"name": "s"}}], "operators": [{"type": "filter", "condition": "json:$.amount>5"}, {"type": "keyby", "key_expression": "$.user"}, {"type": "aggregate", "function": "sum", "field": "$.amount"}], "sinks": [{"stream": {"name": "out"}}, {"kv": {"key_prefix": "p"}}]}


def change(**kw):
    return json.dumps({**JOB, **kw})


@pytest.mark.parametrize(
    ("text", "said"),
    [
        (change(kind="X"), "kind"), (change(extra=1), "extra"), (change(sources=[]), "sources"), (change(sources=[{"stream": {"name": "a"}}, {"stream": {"name": "a"}}]), "once"), (change(sources=[{"stream": {"name": "a"}, "ts": {"measurement": "b"}}]), "exactly one"),
        (change(operators=[{"type": "join"}]), "join"), (change(operators=[{"type": "dedup"}]), "dedup"), (change(operators=[{"type": "aggregate", "function": "sum", "field": "a", "window": "tumbling"}]), "window"), (change(operators=[{"type": "aggregate", "function": "count", "event_time_field": "t"}]), "event_time_field"),
        (change(operators=[{"type": "filter", "condition": "what"}]), "condition"), (change(operators=[{"type": "filter"}]), "condition"), (change(sinks=[{"kv": {"key_prefix": "x"}, "queue": {"name": "q"}}]), "exactly one"), (change(sources=[{"ts": {"measurement": "m"}}]), "kv"), (change(sinks=[{"stream": {"name": "o", "namespace": "other"}}]), "namespace"),
        (change(sources=[{"stream": {"name": "a", "partition": 1}}]), r"sources\[0\].stream.partition"), (change(sources=[{"stream": {"name": "a", "partitions": 3}}]), "partitions"), (change(sources=["a"]), r"sources\[0\]: must be a mapping"), (change(sources=[{"stream": "a"}]), "mapping"),
        (change(match=5), "job.match"), (change(sinks=[{"stream": {"name": "o"}, "match": 5}]), "match"), (change(sinks=[{"stream": {"name": "o"}, "match": ["a", 1]}]), r"match\[1\]"), (change(operators=[{"type": "classify", "rules": [{"tag": "x"}]}]), r"rules\[0\].condition"),
        (change(operators=[{"type": "classify", "rules": [{"condition": "not_empty"}]}]), r"rules\[0\].tag"), (change(operators=[{"type": "filter", "condition": 5}]), "condition"), (change(sinks=[{"queue": {"priority": "high"}}]), "priority"), (change(batch_size=0), "batch_size"), (change(batch_size=-5), "batch_size"),
        (change(batch_size="many"), "batch_size"), (change(batch_size=True), "batch_size"), (change(sources=[{"ts": {"measurement": "m", "lateness_ms": "1s"}}], sinks=[{"stream": {"name": "o"}}]), "lateness_ms"), (change(sinks=[{"kv": {"ttl_ms": -1}}]), "ttl_ms"), (change(sinks=[{"kv": {"ttl_ms": "5"}}]), "ttl_ms"),
        (change(sinks=[{"kv": {"prefix": "p"}}]), "kv.prefix"), (change(sinks=[{"ts": {"field": "x"}}]), "ts.field"), (change(sinks=[{"ts": {"tags": {"a": 1}}}]), "tags.a"), (change(name=5), "name"), (change(operators=[{"type": "map", "x": ["a"]}]), r"operators\[0\].x"),
        (change(operators=[{"type": "aggregate", "function": "sum", "field": 5}]), "field"), (change(operators=[{"type": "aggregate", "function": "count", "window": "count", "window_size": 2, "window_count": 2}]), "one of them"),
        (change(operators=[{"type": "aggregate", "function": "count", "window": "count", "window_size": 0}]), "window_size"), (change(operators=[{"type": "aggregate", "function": "count", "window_count": 2}]), "window_count"), ("[1]", "mapping"), ('{"kind":"Processing","kind":"Processing"}', "twice"), (change(sinks=[{"queue": {"name": "q", "priority": 300}}]), "priority"), (change(operators=[{"type": "passthrough"}] * 257), "256"),
    ],
)
def test_refused_jobs(text, said):
    with pytest.raises(JobError, match=said):
        parse_job(text)


def test_yaml_job():
    pytest.importorskip("yaml")
    job = parse_job("kind: Processing\nname: y\nsources:\n  - stream: {name: a}\nsinks:\n  - queue: {priority: 3}\n    name: q\n    match: [hot]\noperators:\n  - type: classify\n    rules:\n      - {condition: 'value_contains:x', tag: hot}\n  - type: map\n    who: $.user\n    n: 5\n")
    assert job.sinks[0].match == ("hot",) and job.sinks[0].settings["name"] == "q" and job.operators[0].kind == "classify"
    assert job.operators[1].settings == {"mapping": {"who": "$.user", "n": "5"}}


@pytest.mark.parametrize("word", ["payment", "refund", "transfer"])
def test_router_jobs(spark, word):
    """Jobs of the shape that routers have: a named source that reads all partitions, a named filter and sink."""
    spec = {"kind": "Processing", "name": f"{word}-router", "namespace": "default", "sources": [{"name": "raw", "stream": {"name": "transactions", "partitions": "all"}}], "operators": [{"type": "filter", "name": f"is-{word}", "condition": f"value_contains:{word}"}], "sinks": [{"name": "output", "stream": {"name": f"{word}s"}}]}
    job = parse_job(json.dumps(spec))
    assert (job.sources[0].name, job.sources[0].reads, job.operators[0].name, job.sinks[0].reads) == ("raw", "transactions", f"is-{word}", f"{word}s")
    df = stream(spark, ["a payment", "a refund", "a transfer", "nothing"])
    assert values(run_chain(job, {"transactions": df})) == [f"a {word}"]


def test_lookup_job(spark):
    spec = {"kind": "Processing", "name": "deposits", "namespace": "default", "sources": [{"name": "hooks", "stream": {"name": "in", "partitions": "all"}}], "operators": [{"type": "filter", "name": "deposits-only", "condition": "value_contains:deposit"}, {"type": "kv_lookup", "name": "known", "lookup_key": "account:${$.account_id}", "namespace": "default", "mode": "filter"}], "sinks": [{"stream": {"name": "out"}}]}
    kv = spark.createDataFrame([("account:1", "x")], "key string, value string")
    df = stream(spark, ['{"type":"deposit","account_id":"1"}', '{"type":"deposit","account_id":"2"}', '{"type":"other","account_id":"1"}'])
    assert values(run_chain(parse_job(json.dumps(spec)), {"in": df}, {"default": kv}.get)) == ['{"type":"deposit","account_id":"1"}']


def test_defaults_of_a_job():
    job = parse_job(json.dumps({"kind": "Processing", "sources": [{"ts": {"measurement": "m", "tags": {"h": "a"}}}, {"stream": {"name": "s", "batch_size": 7, "poll_interval_ms": 50}}], "sinks": [{"ts": {}}, {"stream": {"name": "o"}}], "batch_size": 500}))
    assert job.name == "unnamed-job" and [s.name for s in job.sources] == ["default-source-0", "default-source-1"]
    assert job.sources[0].settings == {"measurement": "m", "field": "", "tags": {"h": "a"}, "lateness_ms": 30_000, "namespace": "default", "batch_size": 500, "poll_interval_ms": 1000}
    assert job.sources[1].settings["batch_size"] == 7 and job.sinks[0].settings["measurement"] == "default-sink-0"


def test_streaming_equals_batch(spark, tmp_path):
    rows = [("s", "", json.dumps({"user": f"u{i % 3}", "amount": i}), i, [], i, i) for i in range(40)]
    df = spark.createDataFrame(rows, RECORD)
    for part in range(4):
        df.where(F.floor(F.col("seq") / 10) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    job = parse_job(json.dumps(JOB))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = start_job(job, {"s": live}, str(tmp_path / "out"))
    q.awaitTermination(120)
    assert q.exception() is None
    batch = run_chain(job, {"s": df})
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "out/sink0-stream")).collect()) == sorted(values(batch))
    last = dict(to_sinks(job, batch))["kv"].collect()
    got = spark.read.parquet(str(tmp_path / "out/sink1-kv")).groupBy("key").agg(F.max_by("value", "batch").alias("value")).collect()
    assert sorted((r.key, r.value) for r in got) == sorted((r.key, r.value) for r in last)


def test_points_as_records(spark):
    from tarnflow.sources.tables import POINTS
    from tarnflow.streaming.lateness import ready_points

    p = spark.createDataFrame([("m", "value", {}, "", t * 10**9, t, float(t)) for t in (10, 20, 50)], POINTS)
    assert values(points_as_records(ready_points(p, 30_000), "m")) == ['{"measurement":"m","value":10.0,"timestamp_ms":10000}', '{"measurement":"m","value":20.0,"timestamp_ms":20000}']


def test_job_lifecycle(spark, tmp_path):
    from tarnflow.streaming.jobs import Jobs, LifecycleError

    df = spark.createDataFrame([("s", "", json.dumps({"user": "u", "amount": i}), i, [], i, i) for i in range(10)], RECORD)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs, job = Jobs(), parse_job(json.dumps({**JOB, "operators": JOB["operators"][:1]}))
    jobs.start(job, {"s": live}, str(tmp_path / "a"), available_now=True)
    jobs._entry("j").query.awaitTermination(60)
    assert jobs.status("j")["state"] == "COMPLETED" and jobs.status("j")["records_in"] == 10 and jobs.status("j")["error"] is None
    jobs.start(job, {"s": live}, str(tmp_path / "a"))
    assert [s["state"] for s in jobs.list()] == ["RUNNING"] and jobs.list("FAILED") == []
    for refused in (lambda: jobs.remove("j"), lambda: jobs.start(job, {"s": live}, str(tmp_path / "a")), lambda: jobs.status("none")):
        with pytest.raises(LifecycleError):
            refused()
    jobs.stop("j")
    jobs.stop("j")
    assert jobs.status("j")["state"] == "STOPPED"
    jobs.cancel("j")
    assert jobs.status("j")["state"] == "CANCELLED"
    jobs.remove("j")
    assert jobs.list() == []


def test_point_source_goes_through_to_a_point_sink(spark):
    from tarnflow.sources.tables import POINTS

    p = spark.createDataFrame([("m", "value", {"h": str(t % 2)}, f"h={t % 2}", t * 10**9 + 7, t, float(t)) for t in range(6)], POINTS)
    spec = {"kind": "Processing", "name": "f", "sources": [{"ts": {"measurement": "m"}}], "operators": [{"type": "map", "x": "y"}, {"type": "aggregate", "function": "count"}, {"type": "filter", "condition": "json:$.count>2"}], "sinks": [{"ts": {"measurement": "out"}}]}
    job = parse_job(json.dumps(spec))
    got = to_sinks(job, run_chain(job, {"m": p}))[0][1].orderBy("pos").collect()
    assert [(r.measurement, r.field, r.tags, r.ts_ns, r.value) for r in got] == [("out", "value", {"h": str(t % 2)}, t * 10**9 + 7, float(t)) for t in (2, 3, 4, 5)]


def test_kv_sink_time_to_live(spark):
    rows = [("s", "a", "1", 5, [], 5, 1), ("s", "a", "2", 9, [], 9, 2), ("s", "", "3", 9, [], 9, 3)]
    df = spark.createDataFrame(rows, "source string, key string, value string, event_time_ms long, tags array<string>, ts_ms long, seq long")
    stamped = logs.sink_kv(df, "p", ttl_ms=100)
    assert sorted(map(tuple, stamped.collect())) == [("p:", "3", 109_000_000), ("p:a", "2", 109_000_000)]
    assert {r.expiry_ns for r in logs.sink_kv(df, "p", ttl_ms=100, now_ms=1000).collect()} == {1_100_000_000}
    assert logs.sink_kv(df, "p").columns == ["key", "value"] and logs.sink_kv(df).count() == 1
    with pytest.raises(ValueError):
        logs.sink_kv(df, ttl_ms=0)


def test_late_points_batch_equals_stream(spark, tmp_path):
    """Points in three files: one within the lateness behind the newest is read, one behind it is late and counted, and
    what may still be overtaken waits for newer ones."""
    import json as j

    from tarnflow.sources.tables import POINTS
    from tarnflow.streaming.jobs import Jobs
    from tarnflow.streaming.lateness import hold_back, mark_late, ready_points

    at = [10_000, 20_000, 18_000, 9_000, 30_000, 26_500, 27_500, 30_000]
    rows = [("m", "value", {"h": "ab"[i % 2]}, f"h={'ab'[i % 2]}", t * 10**6, i, float(i)) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, POINTS)
    for low, high in ((0, 2), (2, 5), (5, 8)):
        df.where(F.col("pos").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert [r.pos for r in mark_late(df, 3000).where("late").orderBy("pos").collect()] == [3, 5]
    assert [r.pos for r in ready_points(df, 3000).orderBy("ts_ns", "pos").collect()] == [0, 2, 1]

    live = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = hold_back(live, 3000, idle=False).writeStream.format("parquet").option("path", str(tmp_path / "held")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "held")).collect()
    assert sorted(r.pos for r in got if not r.late) == [0, 1, 2] and sorted(r.pos for r in got if r.late) == [3, 5]
    assert {r.pos: r.tags for r in got}[1] == {"h": "b"}

    spec = {"kind": "Processing", "name": "late", "sources": [{"ts": {"measurement": "m", "lateness_ms": 3000, "poll_interval_ms": 100}}], "sinks": [{"stream": {"name": "o"}}]}
    job, jobs = parse_job(j.dumps(spec)), Jobs()
    batch = values(run_chain(job, {"m": df}))
    jobs.start(job, {"m": live}, str(tmp_path / "job"))
    import time

    for _ in range(60):  # the field goes quiet, and what is held is released after its lateness
        time.sleep(0.5)
        if jobs.status("late")["records_out"] == 6:
            break
    status = jobs.status("late")
    jobs.stop("late")
    assert (status["records_out"], status["dropped"], status["late_points"]) == (6, 0, 2)
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "job/sink0-stream")).collect()) == sorted(batch)


def test_a_source_applies_its_field_and_exact_tags(spark):
    from tarnflow.sources.tables import POINTS

    p = spark.createDataFrame([("m", f, t, "", 10**9 * i, i, float(i)) for i, (f, t) in enumerate([("value", {"h": "a"}), ("value", {"h": "a", "z": "1"}), ("other", {"h": "a"}), ("value", {"h": "b"}), ("value", {"h": "a"})])], POINTS)
    job = parse_job(json.dumps({"kind": "Processing", "sources": [{"ts": {"measurement": "m", "tags": {"h": "a"}}}], "sinks": [{"stream": {"name": "o"}}]}))
    assert [json.loads(v)["timestamp_ms"] for v in values(run_chain(job, {"m": p}))] == [0, 4000]
    job = parse_job(json.dumps({"kind": "Processing", "sources": [{"ts": {"measurement": "m", "field": "other"}}], "sinks": [{"stream": {"name": "o"}}]}))
    assert len(values(run_chain(job, {"m": p}))) == 1


def test_sinks_count_what_they_drop(spark, tmp_path):
    df = stream(spark, ['{"v":1}', '{"v":"x"}', "NaN", "2.5", "z" * 70_000])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    job = parse_job(json.dumps({"kind": "Processing", "sources": [{"stream": {"name": "s"}}], "sinks": [{"ts": {"measurement": "m", "value_field": "v"}}, {"kv": {}}, {"queue": {"name": "q"}}, {"stream": {"name": "o"}}]}))
    start_job(job, {"s": live}, str(tmp_path / "out")).awaitTermination(120)
    got = {r.kind: (r.taken, r.dropped) for r in spark.read.parquet(str(tmp_path / "out/counters")).collect()}
    assert got == {"ts": (5, 3), "kv": (5, 5), "queue": (5, 1), "stream": (5, 0)}


def test_lookups_of_a_stream_see_new_keys(spark, tmp_path):
    """The kv frame is built for each micro-batch: a key set between two of them is found by the second."""
    df = stream(spark, ['{"id":"a"}', '{"id":"b"}'])
    for i in (0, 1):
        df.where(F.col("seq") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    asked = []

    def kv(_):
        asked.append(1)
        return spark.createDataFrame([("a" if len(asked) == 1 else "b", "1")], "key string, value string")

    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = parse_job(json.dumps({"kind": "Processing", "sources": [{"stream": {"name": "s"}}], "operators": [{"type": "kv_lookup", "lookup_key": "${$.id}"}], "sinks": [{"stream": {"name": "o"}}]}))
    start_job(job, {"s": live}, str(tmp_path / "out"), kv).awaitTermination(120)
    assert len(asked) == 2 and spark.read.parquet(str(tmp_path / "out/sink0-stream")).count() == 2


def test_user_functions(spark, tmp_path):
    from dataclasses import replace

    from tarnflow.plans.job_definition import Step
    from tarnflow.streaming import user_functions

    @user_functions.register("tagger")
    def tagger(pdf):
        out = pdf[pdf["value"].str.len() > 1].copy()
        out["tags"] = [["long"] if len(v) > 3 else [] for v in out["value"]]
        return out

    @user_functions.register("counter", stateful=True)
    def counter(pdf, state):
        n = state.get("n", 0) + 1 + pdf.reset_index(drop=True).index
        state["n"] = int(n[-1])
        return pdf.assign(value=[f"{k}{i}" for k, i in zip(pdf["key"], n, strict=True)])

    try:
        df = stream(spark, ["aaaa", "b", "cc", "dddd"], ["x", "y", "x", "x"])
        base = parse_job(change(operators=[], sinks=[{"stream": {"name": "o"}}]))
        job = replace(base, operators=(Step("function", {"function": "tagger"}), Step("function", {"function": "counter"})))
        out = run_chain(job, {"s": df})
        assert values(out) == ["x1", "x2", "x3"] and values(records.route(out, ["long"])) == ["x1", "x3"]
        for i in range(4):
            df.where(F.col("seq") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        start_job(job, {"s": live}, str(tmp_path / "out")).awaitTermination(120)
        assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "out/sink0-stream")).collect()) == ["x1", "x2", "x3"]
        with pytest.raises(ValueError):
            user_functions.register("tagger")(tagger)
    finally:
        user_functions.unregister("tagger")
        user_functions.unregister("counter")
    with pytest.raises(ValueError, match="no function"):
        user_functions.apply_function(df, "tagger")


def test_count_windows_over_batches(spark, tmp_path):
    """Windows of three records that begin in one micro-batch and end in another."""
    df = stream(spark, [json.dumps({"u": "ab"[i % 2], "n": float(i * 7 % 11)}) for i in range(20)])
    for part in range(3):
        df.where(F.floor(F.col("seq") / 7) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for function in ("avg", "min"):
        job = parse_job(change(operators=[{"type": "keyby", "key_expression": "$.u"}, {"type": "aggregate", "function": function, "field": "$.n", "window": "count", "window_count": 3}], sinks=[{"stream": {"name": "o"}}]))
        live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        start_job(job, {"s": live}, str(tmp_path / function)).awaitTermination(120)
        assert sorted(r.value for r in spark.read.parquet(str(tmp_path / function / "sink0-stream")).collect()) == sorted(values(run_chain(job, {"s": df})))


def test_a_batch_that_runs_again_replaces_its_writes(spark, tmp_path):
    """Without the mark that a batch was committed, the next start runs it again: sinks and counters stay as they were."""
    df = stream(spark, [json.dumps({"user": f"u{i % 2}", "amount": i}) for i in range(9)])
    for part in range(3):
        df.where(F.floor(F.col("seq") / 3) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    job = parse_job(json.dumps(JOB))
    read = lambda what: sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / what)).collect()), key=repr)
    live = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_job(job, {"s": live()}, str(tmp_path / "out")).awaitTermination(120)
    before = [read(x) for x in ("sink0-stream", "sink1-kv", "counters")]
    last = max((tmp_path / "out/checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    start_job(job, {"s": live()}, str(tmp_path / "out")).awaitTermination(120)
    assert [read(x) for x in ("sink0-stream", "sink1-kv", "counters")] == before


def test_blocking_read(spark, tmp_path):
    from tarnflow.streaming.runner import blocking_read

    df = stream(spark, list("abcdef"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert [r.value for r in blocking_read(live, (2, 2), 2)] == ["d", "e"]
    assert blocking_read(live, (9, 9), timeout_s=3) == []


def test_event_time_streams_equal_tables(spark, tmp_path):
    """Windows, dedup, silence and a join in time on a stream in three batches, the last of which moves time far on."""
    from tarnflow.streaming import event_time

    rows = [("s", "ab"[i % 2], str(i % 5), 4000 + i * 1000, [], i * 1000, i) for i in range(20)] + [("s", "z", "99", 10_000_000, [], 10_000_000, 99)]
    df = spark.createDataFrame(rows, RECORD)
    for low, high in ((0, 9), (10, 19), (20, 200)):
        df.where(F.col("seq").between(low, high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def streamed(out, name):
        q = out.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).where("key <> 'z'").collect()))

    table = lambda out: sorted(map(tuple, out.where("key <> 'z'").collect()))
    for name, make in (("w", lambda d: event_time.window_aggregate(d, "count", None, 4000)), ("d", lambda d: event_time.dedup(d, ["key", "value"], 60_000).select("key", "value", "seq")), ("j", lambda d: event_time.join_within(d.where("key = 'a'"), d.where("key = 'a'"), 2000).select("key", "left_seq", "right_seq"))):
        assert streamed(make(live()), name) == table(make(df)), name
    assert streamed(event_time.watch_silence(live(), 5000).select("key", "last_ms"), "q") == [("a", 22_000), ("b", 23_000)]
    assert event_time.quiet_keys(df, 5000, 30_000).where("key <> 'z'").count() == 2
    for bad in (lambda: event_time.window_aggregate(df, "count", None, 0), lambda: event_time.session_aggregate(df, "count", None, 0), lambda: event_time.join_within(df, df, -1), lambda: event_time.timed(df, -1)):
        with pytest.raises(ValueError):
            bad()


def _tied_lineitem(spark, path):
    """Several items share each position; ship dates rise with it, so that the order within a position counts."""
    at = "timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(cast(id * 7919 % 2000 div 20 + hash(id) % 20 as int))"
    df = spark.range(2000).selectExpr("id * 7919 % 2000 div 8 l_orderkey", "cast(1 + id % 2 as int) l_linenumber", "cast(id as double) l_quantity", "1d l_extendedprice", "0d l_discount", "0d l_tax", "'A' l_returnflag", "'F' l_linestatus", f"{at} l_shipdate")
    df.repartition(3).write.parquet(f"{path}/lineitem.parquet")


def _in_time_order(sql, path, order, tie):
    """Rows of a query's SQL, ties of whose order are settled by time."""
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet/*.parquet'")
    assert f"ORDER BY {order} ROWS" in sql
    return sorted(db.execute(sql.replace(f"ORDER BY {order} ROWS", f"ORDER BY {order}, {tie} ROWS")).fetchall())


@pytest.mark.parametrize("small", [True, False])
def test_late_points_of_one_position(spark, tmp_path, monkeypatch, small):
    """Four fields of the same rows have the same late points, and those are the SQL's with ties in time order."""
    from tarnflow.operators import ordered
    from tarnflow.plans.chain_registry import ORACLES, QUERIES
    from tarnflow.sources.tables import POINTS
    from tarnflow.streaming.lateness import mark_late, ready_points

    if not small:
        monkeypatch.setattr(ordered, "SMALL_BYTES", 0)
        monkeypatch.setattr(ordered, "CHUNK_ROWS", 500)
    rows = [("m", "value", {}, "", t * 10**9, p, float(t)) for p, t in ((0, 90), (0, 10), (0, 50), (1, 95), (1, 20), (2, 80))]
    for data in (rows, rows[::-1]):
        df = spark.createDataFrame(data, POINTS).coalesce(1)
        assert sorted(r.value for r in mark_late(df, 10_000).where("late").collect()) == [20, 80]
        assert sorted(r.value for r in ready_points(df, 10_000).collect()) == [10, 50]
    _tied_lineitem(spark, tmp_path)
    got = QUERIES["ts_late_points"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == _in_time_order(ORACLES["ts_late_points"], tmp_path, "l_orderkey * 8 + l_linenumber", "l_shipdate")


@pytest.mark.parametrize("small", [True, False])
def test_late_histogram_of_one_position(spark, tmp_path, monkeypatch, small):
    """As above, for every edge of the histogram."""
    from tarnflow.operators import ordered
    from tarnflow.operators.points import late_histogram
    from tarnflow.plans.registry import ORACLES, QUERIES
    from tarnflow.sources.tables import POINTS

    if not small:
        monkeypatch.setattr(ordered, "SMALL_BYTES", 0)
        monkeypatch.setattr(ordered, "CHUNK_ROWS", 500)
    rows = [("m", "value", {}, "", t * 10**9, p, float(t)) for p, t in ((0, 90), (0, 10), (0, 50), (1, 95), (1, 20), (2, 80))]
    for data in (rows, rows[::-1]):
        r = late_histogram(spark.createDataFrame(data, POINTS).coalesce(1)).first()
        assert (r.late_0, r.late_5000, r.late_15000, r.late_60000) == (2, 2, 1, 1)
    _tied_lineitem(spark, tmp_path)
    got = QUERIES["ts_late_histogram"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == _in_time_order(ORACLES["ts_late_histogram"], tmp_path, "pos", "ts_ns")


def test_strict_limits(spark):
    from tarnflow.operators.series import run_pipe
    from tarnflow.sources.tables import POINTS

    p = spark.range(5000).selectExpr("'m' measurement", "'value' field", "cast(map() as map<string,string>) tags", "'' tag_key", "id * 1000000 ts_ns", "id pos", "cast(id as double) value").to(spark.createDataFrame([], POINTS).schema)
    ask = lambda text, strict: run_pipe(lambda a, b: p, text, 10_000, True, strict).count()
    assert ask("m[0..9999]", False) == 5000 and ask("m[0..9999] | window(1s) | sum()", True) == 5
    with pytest.raises(Exception, match="more than 4096"):
        ask("m[0..9999]", True)


def test_strict_query_answers_whole(spark, tmp_path):
    """More clicks than a server scans: the registered query takes them all, while the library's strict limits refuse."""
    from tarnflow.operators.series import MOST_SCANNED, run_pipe
    from tarnflow.plans.chain_registry import HIGH, LOW, QUERIES
    from tarnflow.sources.tables import event_points

    n, sf = MOST_SCANNED + 1, str(tmp_path)
    ts = f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(id * 3 div {n})"
    spark.range(n).selectExpr("id event_id", f"{ts} ts", "id % 9 user_id", "'click' event_type", "1d value").write.parquet(f"{sf}/events.parquet")
    got = QUERIES["pq_strict"](spark, sf).orderBy("ts_ns").collect()
    assert [r.ts_ns - LOW * 10**6 for r in got] == [d * 86_400 * 10**9 for d in range(3)] and sum(r.value for r in got) == n
    ask = lambda **most: run_pipe(lambda a, b: event_points(spark, sf, a, b), f"click[{LOW}..{HIGH}] | window(1d) | sum()", HIGH, True, True, **most).count()
    with pytest.raises(Exception, match=f"scan: more than {MOST_SCANNED}"):
        ask()
    assert ask(most_scanned=n) == ask(most_scanned=None) == 3


def test_catalog_and_pages(spark):
    from tarnflow.operators import points
    from tarnflow.operators.catalog import fold_catalog

    ops = spark.createDataFrame([("s", "x", i, op, None) for i, op in enumerate(["alter", "create", "drop", None, "delete", "delete"])], "scope string, name string, seq long, op string, settings map<string,string>")
    assert [(r.applied, r.exists) for r in fold_catalog(ops).orderBy("seq").collect()] == [(False, False), (True, True), (False, True), (False, True), (True, False), (False, False)]
    df = stream(spark, list("abcde"))
    page = logs.read_stream(df, count=2)
    at = points.next_cursor(page, 2, ("ts_ms", "seq"))
    assert at == (1, 1) and values(logs.read_stream(df, at, count=3)) == ["c", "d", "e"]
    assert points.next_cursor(logs.read_stream(df, (2, 2), count=3), 3, ("ts_ms", "seq")) is None
