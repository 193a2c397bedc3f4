import datetime
import random

import pytest
from pyspark.sql import functions as F

from tarnflow.functions.schedule import latest_fire, latest_fire_ms, parse_schedule
from tarnflow.operators import delivery, keyvalue, logs, ordered

OPS = "scope string, seq long, op string, at_ms long, holder string, msg long, delivery int, count int, priority int, delay_ms long, lease_ms long, bytes long, dead boolean"
FIELDS = [c.split()[0] for c in OPS.split(", ")]
RECORD = "source string, key string, value string, event_time_ms long, tags array<string>, ts_ms long, seq long"


def fold(spark, ops):
    rows = [tuple({"scope": "q", "seq": i, **o}.get(f) for f in FIELDS) for i, o in enumerate(ops)]
    out = delivery.fold_deliveries(spark.createDataFrame(rows, OPS))
    got = {}
    for r in out.collect():
        got.setdefault(r.seq, []).append((r.msg, r.outcome, r.delivery, r.until_ms))
    return out, got


def op(name, at, **kw):
    return {"op": name, "at_ms": at, **kw}


def test_queue_order_and_reports(spark):
    _, got = fold(spark, [
        op("enqueue", 0, priority=5), op("enqueue", 0, priority=1, delay_ms=100), op("enqueue", 1, priority=5), op("deliver", 10, holder="a", count=5), op("deliver", 100, holder="a", count=5),
        op("complete", 110, holder="a", msg=1, delivery=1), op("complete", 110, holder="a", msg=1, delivery=1), op("fail", 110, holder="b", msg=3, delivery=1), op("fail", 110, holder="a", msg=3, delivery=1, delay_ms=50),
        op("fail", 110, holder="a", msg=3, delivery=1, delay_ms=50), op("deliver", 159, holder="a", count=5), op("deliver", 160, holder="b"), op("complete", 161, holder="a", msg=3, delivery=1), op("enqueue", 162, bytes=70000), op("purge", 170),
    ])
    assert [g[0][:2] for g in (got[0], got[1], got[2])] == [(1, "enqueued"), (2, "enqueued"), (3, "enqueued")]
    assert got[3] == [(1, "leased", 1, 30010), (3, "leased", 1, 30010)] and got[4] == [(2, "leased", 1, 30100)]
    assert [got[i][0][1] for i in range(5, 10)] == ["completed", "gone", "other_holder", "failed_ready", "failed_before"]
    assert got[10][0][1] == "nothing" and got[11] == [(3, "leased", 2, 30160)] and got[12][0][1] == "delivered_again" and got[13][0][1] == "too_large" and got[14][0][:2] == (2, "purged")


def test_expiry_extension_and_dead_letters(spark):
    ops = [op("enqueue", 0), op("deliver", 0, holder="a", lease_ms=100), op("extend", 40, holder="a", msg=1, delivery=1), op("extend", 60, holder="a", msg=1, delivery=1), op("tick", 159), op("tick", 160), op("complete", 161, holder="a", msg=1, delivery=1)]
    ops += [op("deliver", 1000 * i, holder="a", lease_ms=100) for i in range(1, 6)] + [op("requeue", 6000, msg=1), op("deliver", 6000, holder="a"), op("fail", 6001, holder="a", msg=1, delivery=6, dead=True), op("discard", 6002, msg=1), op("discard", 6003, msg=1)]
    out, got = fold(spark, ops)
    assert got[2][0][3] == 100 and got[3][0][3] == 160 and 4 not in got and got[5] == [(1, "expired_ready", 1, 160)] and got[6][0][1] == "expired"
    assert [o[1] for o in got[10]] == ["expired_ready", "leased"] and [o[1] for o in got[11]] == ["expired_dead", "nothing"]
    assert got[12][0][1] == "requeued" and got[13] == [(1, "leased", 6, 36000)] and got[14][0][1] == "failed_dead" and got[15][0][1] == "discarded" and got[16][0][1] == "gone"
    assert [r.state for r in delivery.message_states(out).collect()] == ["gone"]
    empty = spark.createDataFrame([], OPS)
    assert delivery.fold_deliveries(empty).count() == 0


def test_many_queues_equal_each_alone(spark):
    rng, rows = random.Random(3), []
    for i in range(1500):
        q = rng.choice("aaab") + rng.choice("xy")
        kind = rng.choice(("enqueue", "enqueue", "deliver", "complete", "fail", "tick"))
        rows.append((q, i, kind, i * 700, "h", rng.randint(1, 40) if kind in ("complete", "fail") else None, rng.randint(1, 2), 3, rng.randint(0, 2), rng.randint(0, 9) * 1000, None, 1, None))
    df = spark.createDataFrame(rows, OPS)
    got = sorted(map(repr, delivery.fold_deliveries(df).collect()))
    alone = []
    for q in ("ax", "ay", "bx", "by"):
        alone += map(repr, delivery.fold_deliveries(df.where(F.col("scope") == q)).collect())
    assert got == sorted(alone) and len(got) > 500


def test_group_reads_records_once_and_again_after_a_failure(spark):
    records = spark.createDataFrame([("s", "", f"v{i}", i, [], i * 10, i) for i in range(1, 8)], RECORD)
    rows = [("s", "g", 1, "read", 35, "a", None, None, 2, None), ("s", "g", 2, "read", 35, "b", None, None, 5, None), ("s", "g", 3, "fail", 36, "a", 1, 1, None, 0), ("s", "g", 4, "read", 45, "b", None, None, 2, None), ("s", "g", 5, "steal", 50, "c", 2, 1, None, 10), ("s", "g", 6, "steal", 50, "c", 2, 2, None, 10), ("s", "g", 7, "complete", 60, "c", 2, 2, None, None), ("s", "other", 1, "read", 1000, "z", None, None, 100, None)]
    ops = spark.createDataFrame(rows, "stream string, group string, seq long, op string, at_ms long, holder string, msg long, delivery int, count int, delay_ms long")
    out = delivery.group_deliveries(ops, records)
    got = {}
    for r in out.orderBy("seq", "msg").collect():
        got.setdefault((r.group, r.seq), []).append((r.record_seq, r.outcome, r.delivery))
    assert got["g", 1] == [(1, "leased", 1), (2, "leased", 1)] and got["g", 2] == [(3, "leased", 1)] and got["g", 3] == [(1, "failed_ready", 1)]
    assert got["g", 4] == [(1, "leased", 2), (4, "leased", 1)] and got["g", 5] == [(2, "leased", 2)] and got["g", 6] == [(2, "not_idle", None)] and got["g", 7] == [(2, "completed", 2)]
    assert len(got["other", 1]) == 7
    assert {(r.group, r.holder): r.held for r in delivery.members(out).collect()} == {("g", "b"): 3, ("other", "z"): 7}


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_running_values_spread_over_stretches(spark, rows):
    rng = random.Random(rows)
    data = [(rng.choice(["hot", "hot", "cold", None]), rng.randint(0, 300), i, rng.choice([None, 1.0, 2.0, -3.0])) for i in range(400)]
    df = spark.createDataFrame(data, "k string, t long, s long, v double")
    for before in (False, True):
        out = ordered.running(df, ["k"], ["t", "s"], {"n": ("count", "v"), "total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v")}, before, rows)
        got = {r.s: (r.n, r.total, r.low, r.high) for r in out.collect()}
        assert len(got) == 400
        for k, t, s, _ in data:
            seen = [x[3] for x in data if x[0] == k and ((x[1], x[2]) < (t, s) or (not before and x[2] == s)) and x[3] is not None]
            assert got[s] == (len(seen), sum(seen) if seen else None, min(seen, default=None), max(seen, default=None))
    assert ordered.ordinals(df.limit(0), ["k"], ["t", "s"]).count() == 0


def test_trims(spark):
    df = spark.createDataFrame([(s, "", "v", i, [], i // 2, i) for s in ("a", "b") for i in range(10)], RECORD)
    assert sorted((r.source, r.seq) for r in logs.trim(df, newest=3).collect()) == [(s, i) for s in ("a", "b") for i in (7, 8, 9)]
    assert logs.trim(df, max_age_ms=2, now_ms=5).count() == 8
    assert {(r.source, r.deleted, r.first_seq) for r in logs.trim_report(df, newest=3).collect()} == {("a", 7, 7), ("b", 7, 7)}
    assert [r.deleted for r in logs.trim_report(df, before_ms=99).collect()] == [10, 10]
    for bad in ({}, {"newest": 1, "before_ms": 1}, {"newest": 0}, {"max_age_ms": 5}):
        with pytest.raises(ValueError):
            logs.trim(df, **bad)


def test_history_and_namespaces(spark):
    v = spark.createDataFrame([("n", "k", i, str(i), i == 3) for i in range(1, 8)] + [("n", "x", 1, None, True)], "ns string, key string, version long, value string, tombstone boolean")
    assert [r.version for r in keyvalue.history(v, 64).where("key = 'k'").orderBy("rank").collect()] == [7, 6, 5, 4, 3]
    assert [r.version for r in keyvalue.history(v, 2).where("key = 'k'").orderBy("rank").collect()] == [7, 6]
    assert tuple(keyvalue.namespace_summary(v).first()) == ("n", 1, 8, 7)


@pytest.mark.parametrize("text", ["* * * * *", "*/15 2-6/2 * * *", "0 0 29 2 *", "5 4 13 * 5", "0 12 * * 7", "30 6 1,15 1-6 *"])
def test_schedules_by_brute_force(spark, text):
    rng, s = random.Random(text), parse_schedule(text)
    for _ in range(20):
        now = rng.randint(1_500_000_000, 1_800_000_000) * 1000
        at = datetime.datetime.fromtimestamp(now // 60_000 * 60, datetime.UTC)
        day = at.date()
        while not (s.fires_on(day) and any((day, h, m) <= (at.date(), at.hour, at.minute) for h in s.hours for m in s.minutes)):
            day -= datetime.timedelta(1)
        h, m = max((h, m) for h in s.hours for m in s.minutes if (day, h, m) <= (at.date(), at.hour, at.minute))
        want = int(datetime.datetime(day.year, day.month, day.day, h, m, tzinfo=datetime.UTC).timestamp() * 1000)
        assert latest_fire_ms(text, now) == want
    df = spark.createDataFrame([(now,), (None,)], "ms long")
    assert [r.f for r in df.select(latest_fire(F.col("ms"), text).alias("f")).collect()] == [want, None]


@pytest.mark.parametrize("bad", ["* * * *", "60 * * * *", "*/0 * * * *", "5-2 * * * *", "x * * * *", "* * 0 * *", "* * * * 8"])
def test_refused_schedules(bad):
    with pytest.raises(ValueError):
        parse_schedule(bad)


def test_no_fire_in_four_years():
    assert latest_fire_ms("0 0 31 2 *", 1_700_000_000_000) is None
