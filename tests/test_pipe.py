import pytest
from pyspark.sql import functions as F

from tarnflow.functions.text import glob_regex, person_duration_ms, pipe_duration_ms
from tarnflow.operators import points
from tarnflow.operators.series import run_pipe
from tarnflow.plans.pipe_language import PipeError, parse
from tarnflow.sources.line_protocol import parse_lines
from tarnflow.sources.tables import POINTS

NS = 1_000_000_000


def source(spark, rows, m="test"):
    """rows: (tags, ts_ns, value)"""
    data = [(m, "value", t, ",".join(sorted(f"{k}={v}" for k, v in t.items())), ts, i, float(v)) for i, (t, ts, v) in enumerate(rows)]
    df = spark.createDataFrame(data, POINTS)
    return lambda low, high: df


def run(spark, rows, stages, merged=False, m="test", select="", window="[0..100000000]"):
    out = run_pipe(source(spark, rows, m), f"{m}{select}{window}{stages}", 0, merged)
    return sorted((r.series_key, r.ts_ns, round(r.value, 6)) for r in out.collect())


RAMP = [({}, i * NS, 10 * (i + 1)) for i in range(6)]


@pytest.mark.parametrize(
    ("stages", "want"),
    [
        ("| window(3s) | avg()", [(0, 20), (3, 50)]), ("| window(3s) | sum()", [(0, 60), (3, 150)]), ("| rate(1s)", [(i, 10) for i in range(1, 6)]), ("| delta()", [(i, 10) for i in range(1, 6)]),
        ("| where(value > 35)", [(3, 40), (4, 50), (5, 60)]), ("| window(10s) | percentile(95)", [(0, 57.5)]), ("| first()", [(0, 10)]), ("| last()", [(5, 60)]), ("| math(/ 0) | last()", [(5, 60)]),
        ("| math(% 7)", [(0, 3), (1, 6), (2, 2), (3, 5), (4, 1), (5, 4)]), ("| window(3s) | sum() | window(10s) | max()", [(0, 150)]), ("| topk(0)", []),
    ],
)
def test_ramp(spark, stages, want):
    assert run(spark, RAMP, stages) == [("test", t * NS, v) for t, v in want]


def test_buckets_start_at_the_earliest_point(spark):
    assert run(spark, [({}, 2500, 1), ({}, 500, 2), ({}, 1500, 3)], "| window(1s) | count()") == [("test", 500, 3)]
    with pytest.raises(Exception, match="too many buckets"):
        run(spark, [({}, 0, 1), ({}, 1_000_001 * NS, 2)], "| window(1s) | count()", window="[0..2000000000]")


def test_rate_reset_and_equal_times(spark):
    rows = [({}, 0, 5), ({}, NS, 9), ({}, NS, 11), ({}, 2 * NS, 3)]
    assert run(spark, rows, "| rate(1m)") == [("test", NS, 4), ("test", 2 * NS, 3)]
    assert run(spark, rows, "| delta()") == [("test", NS, 2), ("test", NS, 4), ("test", 2 * NS, -8)]


def test_ranking_and_grouping(spark):
    rows = [({"s": "a"}, 1, 100), ({"s": "b"}, 1, 300), ({"s": "c"}, 1, 200)]
    assert [k for k, _, _ in run(spark, rows, "| topk(2)")] == ["test,s=b", "test,s=c"]
    assert [k for k, _, _ in run(spark, rows, "| bottomk(2)")] == ["test,s=a", "test,s=c"]
    rows = [({"host": "w1", "dc": "us"}, 1, 1), ({"host": "w1", "dc": "eu"}, 2, 2), ({}, 3, 3)]
    assert run(spark, rows, "| group_by(host)") == [("test,host=_untagged_", 3, 3), ("test,host=w1", 1, 1), ("test,host=w1", 2, 2)]
    assert {k for k, _, _ in run(spark, rows, "| group_by(host)", merged=True)} == {"test,host=_untagged_"}


HOSTS = [({"host": "web-01", "env": "prod"}, 1, 10), ({"host": "web-02", "env": "prod"}, 2, 20), ({"host": "api-01", "env": "prod"}, 3, 30), ({"host": "web-100", "env": "dev"}, 4, 40), ({}, 5, 5)]


@pytest.mark.parametrize(("select", "want"), [("{host=~web-*}", [10, 20, 40]), ("{host!~web-*}", [30, 5]), ("{env!=dev}", [10, 20, 30, 5]), ("{env=prod,host=~web-*}", [10, 20]), ("{host=~web-0?}", [10, 20]), ('{host="api-01"}', [30]), ("{no!=x}", [10, 20, 30, 40, 5]), ("{no=x}", [])])
def test_tags(spark, select, want):
    assert sorted(v for _, _, v in run(spark, HOSTS, "", select=select)) == sorted(want)


@pytest.mark.parametrize("text", ["cpu{}", "cpu | median()", "cpu | avg(1)", "cpu[1h..2h]", "cpu[-5]", "cpu | topk(-1)", "cpu | percentile(101)", "cpu | window(0s)", "cpu | window(5ms)", "cpu | math(^ 2)", "cpu | where(value > x)", "cpu[99999999999999]", "cpu{a~b}", "cpu | math(% -2)"])
def test_refused(text):
    with pytest.raises(PipeError):
        parse(text, 10**12)


def test_parse():
    q = parse("cpu.load{a='x y',b!~c*}[2h..1h] | field(user) | window(5m) | round() junk", 10**12)
    assert (q.field, q.low_ms, q.high_ms) == ("user", 10**12 - 7_200_000, 10**12 - 3_600_000)
    assert [s.args for s in q.stages] == [("user",), (300_000,), (0,)]
    assert parse("cpu", 10**12).low_ms == 10**12 - 3_600_000
    assert (parse("cpu[5]", 0).low_ms, parse("cpu[5]", 0).high_ms) == (5, None)


def test_text_helpers():
    assert glob_regex("a.b*?") == r"(?s)^a\.b.*.$"
    assert pipe_duration_ms("5m") == person_duration_ms("300s") == 300_000
    assert person_duration_ms("0") == 0
    for bad in ("5", "1.5s", "-1s", ""):
        with pytest.raises(ValueError, match="duration"):
            person_duration_ms(bad)


def test_bucket_query_is_epoch_aligned(spark):
    base = 1708700400000
    df = source(spark, [({}, (base + d) * 1_000_000, v) for d, v in ((0, 10), (30_000, 20), (120_000, 90))])(0, 0)
    got = lambda w: sorted((r.start_ns // 1_000_000, r.value) for r in points.bucket_query(df, "test", window_ns=w * NS).collect())
    assert got(60) == [(base, 15.0), (base + 120_000, 90.0)]
    assert got(300) == [(base, 40.0)]
    for bad in ({"agg": "median"}, {"window_ns": 0}):
        with pytest.raises(ValueError, match="window|aggregation"):
            points.bucket_query(df, "test", **bad)


@pytest.mark.parametrize("descending", [False, True])
def test_pages_walk_every_point_once(spark, descending):
    df = source(spark, [({}, i // 3, i) for i in range(20)])(0, 0).cache()
    seen, after = [], None
    while page := points.read_page(df, "test", limit=7, descending=descending, after=after).collect():
        seen += [r.value for r in page]
        after = (page[-1].ts_ns, page[-1].pos)
    assert seen == sorted(range(20), reverse=descending)


def test_late_histogram(spark):
    rows = [({}, t * NS, 0) for t in (100, 90, 100, 130, 99)]
    r = points.late_histogram(source(spark, rows)(0, 0)).first()
    assert (r.late_0, r.late_5000, r.late_30000, r.late_60000) == (2, 2, 1, 0)


def test_line_protocol(spark):
    lines = ["cpu,host=web-01 user=72.5,system=7.4 1708700400000", "", "# note", "memory,host=web-01 used=4096i 1708700400000", "m f=true 1", 'm f="text" 1', "m,a=1,a=2 f=1 1", "m f=1,f=2 1", "m f=1 0", "m f=1 9300000000000", "m f=9007199254740993i 1", "nofields 1", "m f=1 1 extra"]
    ok, bad = parse_lines(spark.createDataFrame(list(enumerate(lines)), "line_no int, text string"))
    got = sorted((r.measurement, r.field, r.tag_key, r.ts_ns, r.value) for r in ok.collect())
    at = 1708700400000 * 1_000_000
    assert got == [("cpu", "system", "host=web-01", at, 7.4), ("cpu", "user", "host=web-01", at, 72.5), ("m", "f", "", 1_000_000, 1.0), ("memory", "used", "host=web-01", at, 4096.0)]
    assert sorted(r.line_no for r in bad.collect()) == list(range(5, 13))


def test_range_reaches_the_scan(spark, sf):
    from tarnflow.sources.tables import event_points

    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = event_points(spark, sf, 1704067200000 * 1_000_000, None).where(F.col("measurement") == "click")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(ts" in plan and "EqualTo(event_type,click)" in plan


@pytest.mark.parametrize("rows", [7, None])
def test_values_before_equal_a_plain_walk(spark, rows):
    """Previous and running values over stretches, with most rows crowded into a short time, ties, nulls and one far away."""
    from pyspark.sql import functions as F

    from tarnflow.operators.ordered import previous, running, with_stretch

    at = [0] + [10**12 + i // 3 for i in range(200)] + [10**15]
    table = [("ab"[i % 5 == 0], t, i, None if i % 11 == 0 else float(i * 7 % 13)) for i, t in enumerate(at)] + [(None, 5, 900, 1.0), (None, 10**12, 901, 2.0)]
    df = spark.createDataFrame(table, "k string, at long, pos long, v double").repartition(4)
    got = {r.pos: r for r in previous(df, ["k"], ["at", "pos"], {"v0": "v", "p0": "pos"}, rows=rows).collect()}
    sums = {r.pos: (r.s, r.n) for r in running(df, ["k"], ["at", "pos"], {"s": ("sum", "v"), "n": ("count", "v")}, rows=rows).collect()}
    assert len(got) == len(sums) == len(table)
    last, total = {}, {}
    for k, _, pos, v in sorted(table, key=lambda r: (r[1], r[2])):
        assert (got[pos].v0, got[pos].p0) == last.get(k, (None, None))
        last[k] = (v, pos)
        s, n = total.get(k, (None, 0))
        total[k] = (s, n) if v is None else ((s or 0.0) + v, n + 1)
        assert sums[pos] == total[k]
    if rows == 7:
        sizes = [r["count"] for r in with_stretch(df, "at", 7).groupBy("_stretch").count().collect()]
        assert max(sizes) <= 30 and len(sizes) > 15
    assert previous(df.where("false"), ["k"], ["at", "pos"], {"v0": "v"}, rows=rows).count() == 0
    assert with_stretch(df.withColumn("at", F.lit(None).cast("long")), "at", 7).select("_stretch").distinct().count() == 1


def test_rate_of_many_stretches(spark, monkeypatch):
    """rate and delta of one hot series, over stretches."""
    from tarnflow.operators import ordered

    rows = [("m", "value", {"h": "a"}, "h=a", i * 10**9, i, float(i * i % 17)) for i in range(300)]
    df = spark.createDataFrame(rows, POINTS)
    source = lambda low, high: df
    want = {s: sorted(map(tuple, run_pipe(source, f"m[0..400000] | {s}", 400_000, True).collect())) for s in ("rate(1m)", "delta()")}
    monkeypatch.setattr(ordered, "SMALL_BYTES", 0)
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 20)
    for s, rows in want.items():
        assert len(rows) in (299, 300) and sorted(map(tuple, run_pipe(source, f"m[0..400000] | {s}", 400_000, True).collect())) == rows
