import random

import duckdb
import pytest

from tidemark import queries
from tidemark.plans import influxql, opentsdb, promql
from tidemark.sources import protocols
from tidemark.schema import SchemaError

SAMPLES = [(0, 10.0), (15000, 14.0), (30000, 20.0), (45000, 3.0), (60000, 9.0), (90000, 21.0)]
GRID = promql.Grid(0, 120000, 30000)


def by_hand(name, samples, t, r):
    d = sorted(x for x in samples if t - r <= x[0] <= t)
    n = len(d) - 1
    if name in ("irate", "idelta"):
        if n < 2:
            return None
        (t0, v0), (t1, v1) = d[-2:]
        return v1 - v0 if name == "idelta" else (v1 if v1 < v0 else v1 - v0) / ((t1 - t0) / 1000)
    if n < 1:
        return None
    counter = name != "delta"
    diff = d[-1][1] - d[0][1] + (sum(a[1] for a, b in zip(d, d[1:]) if b[1] < a[1]) if counter else 0)
    length = d[-1][0] - d[0][0]
    average = length / n
    head, tail = d[0][0] - (t - r), t - d[-1][0]
    if counter and diff > 0 and d[0][1] >= 0:
        head = min(head, length * d[0][1] / diff)
    head, tail = (average / 2 if x > 1.1 * average else x for x in (head, tail))
    got = diff * (length + head + tail) / length
    return got / (r / 1000) if name == "rate" else got


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("rate", {30000: 0.208333333, 60000: 0.316666667, 90000: 0.35, 120000: 0.4}), ("increase", {30000: 12.5, 60000: 19, 90000: 21, 120000: 24}), ("delta", {30000: 12.5, 60000: -1, 90000: 1, 120000: 24}),
        ("irate", {30000: 0.4, 60000: 0.4, 90000: 0.4}), ("idelta", {30000: 6, 60000: 6, 90000: 12}),
    ],
)
def test_range_functions(spark, name, want):
    df = spark.createDataFrame([(1, t, v) for t, v in SAMPLES], "s int, ts long, value double")
    got = {r.ts: r.value for r in promql.range_function(name, df, ["s"], GRID, 60000).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("name", promql.FUNCTIONS)
def test_range_functions_on_random_series(spark, name):
    rng = random.Random(name)
    series = {s: sorted({rng.randrange(0, 600_000): rng.uniform(0, 50) for _ in range(40)}.items()) for s in range(3)}
    df = spark.createDataFrame([(s, t, v) for s, xs in series.items() for t, v in xs], "s int, ts long, value double")
    grid = promql.Grid(50_000, 650_000, 37_000)
    got = {(r.s, r.ts): r.value for r in promql.range_function(name, df, ["s"], grid, 90_000).collect()}
    want = {(s, t): v for s, xs in series.items() for t in range(50_000, 650_001, 37_000) if (v := by_hand(name, xs, t, 90_000)) is not None}
    assert got == pytest.approx(want)


def test_instant(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in SAMPLES], "s int, ts long, value double")
    assert {r.ts: r.value for r in promql.instant(df, ["s"], GRID).collect()} == {0: 10.0, 30000: 20.0, 60000: 9.0, 90000: 21.0, 120000: 21.0}


def test_parser():
    e = promql.parse('sum by (a, b) (rate(m{x="1",y=~"a.*"}[5m] offset 1h))')
    assert e == promql.Aggregate("sum", promql.Call("rate", promql.Selector("m", (("x", "=", "1"), ("y", "=~", "a.*")), 300_000, 3_600_000)), ("a", "b"), False)
    for bad in ("m + 1", "topk(m)", "rate(m)", "sum(m) / 2"):
        with pytest.raises(promql.PromError):
            promql.parse(bad)


@pytest.fixture
def water(engine):
    engine.sql("CREATE TABLE h2o_feet (time timestamp NOT NULL, level_description string TAG, location string TAG, water_level double, value double, timestamp KEY (time)) ENGINE=Analytic WITH (enable_ttl='false')")
    values = ", ".join(
        f'({t}, "{d}", "{p}", {v}, {v})'
        for t, pair in ((1439827200000, (8.12, 2.064)), (1439827560000, (8.005, 2.116)), (1439827620000, (7.887, 2.028)))
        for (d, p), v in zip((("between 6 and 9 feet", "coyote_creek"), ("below 3 feet", "santa_monica")), pair)
    )
    engine.sql(f"INSERT INTO h2o_feet (time, level_description, location, water_level, value) VALUES {values}")
    return engine


def test_influx(water):
    values = lambda q: influxql.respond(water, q)["results"][0]["series"][0]["values"]
    assert values("SELECT level_description, location, water_level FROM \"h2o_feet\" where location = 'santa_monica'") == [[1439827200000, "below 3 feet", "santa_monica", 2.064], [1439827560000, "below 3 feet", "santa_monica", 2.116], [1439827620000, "below 3 feet", "santa_monica", 2.028]]
    assert values("SELECT count(water_level) FROM h2o_feet group by location") == [[0, "coyote_creek", 3], [0, "santa_monica", 3]]
    times = [1439827200000, 1439827500000, 1439827800000, 1439828100000]
    for fill, gap in (("", None), ("fill(666)", 666)):
        got = values(f"SELECT count(water_level) FROM h2o_feet where time < 1439828400000ms group by location, time(5m) {fill}")
        assert got == [[t, p, n] for p in ("coyote_creek", "santa_monica") for t, n in zip(times, (1, 2, gap, gap))]
    assert values("show measurements") == [["h2o_feet"]]
    assert influxql.query(water, "SHOW TAG VALUES FROM h2o_feet WITH KEY = location").count() == 2
    first = values("SELECT * FROM h2o_feet")[0]
    assert first[:4] == [1439827200000, "below 3 feet", "santa_monica", 8247797837995683878]
    for bad in ("SELECT a FROM (SELECT b FROM c)", "SELECT a FROM /x/", "SELECT a FROM b, c", "SELECT value, count(value) FROM h2o_feet"):
        with pytest.raises(influxql.InfluxError):
            influxql.query(water, bad)


def test_opentsdb(water):
    ask = lambda **q: opentsdb.respond(water, {"start": 1439827200000, "end": 1439827620000, "queries": [{"metric": "h2o_feet", **q}]})
    got = ask(aggregator="none", tags={"location": "coyote_creek"})
    assert got == [{"metric": "h2o_feet", "tags": {"level_description": "between 6 and 9 feet", "location": "coyote_creek"}, "aggregatedTags": [], "dps": {"1439827200000": 8.12, "1439827560000": 8.005, "1439827620000": 7.887}}]
    (total,) = ask(aggregator="sum", tags={})
    assert total["tags"] == {} and total["dps"] == pytest.approx({"1439827200000": 10.184, "1439827560000": 10.121, "1439827620000": 9.915})
    assert len(ask(aggregator="max", filters=[{"type": "literal_or", "tagk": "location", "filter": "coyote_creek|santa_monica", "groupBy": True}])) == 2
    with pytest.raises(SchemaError):
        ask(aggregator="none", filters=[{"type": "wildcard", "tagk": "location", "filter": "*"}])


def test_opentsdb_points_at_one_time(spark, tmp_path):
    rows = [("2024-01-05 00:00:00.001", "a", v) for v in (2.0, 1.0, 2.0)] + [("2024-01-05 00:00:00.001", "b", 4.0), ("2024-01-05 00:00:00.0019", "b", None), ("2024-01-05 00:00:02", "a", 3.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double")
    df.selectExpr("cast(ts as timestamp_ntz) as ts", "event_type", "value", "1L as user_id").write.parquet(f"{tmp_path}/events.parquet")
    got = queries.queries()["opentsdb_response"](spark, str(tmp_path))
    want = duckdb.connect()
    want.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    key = lambda r: (r[0], r[1], r[2] is not None, r[2])
    rows = sorted(want.sql(queries.oracle_sql()["opentsdb_response"]).fetchall(), key=key)
    assert len(rows) == 6 and sorted(map(tuple, got.select("event_type", "ts", "value").collect()), key=key) == rows
    request = {"start": queries.START, "end": queries.START + 9999, "queries": [{"metric": "events", "aggregator": "none"}]}
    at = [str(queries.START + 1), str(queries.START + 2000)]
    assert [(r["tags"]["event_type"], r["dps"]) for r in opentsdb.respond(queries.events_engine(spark, str(tmp_path)), request)] == [("a", {at[0]: 2.0, at[1]: 3.0}), ("b", {at[0]: 4.0})]


def test_prom_over_an_engine(water):
    e = promql.Evaluator(water)
    got = e.evaluate(promql.parse('max by (location) (h2o_feet{location!="x"})'), 1439827200000, 1439827800000, 300_000).collect()
    assert {(r.location, r.ts): r.value for r in got}[("coyote_creek", 1439827800000)] == 7.887
    assert e.evaluate(promql.parse('h2o_feet{__field__="water_level"}'), 1439827200000, 1439827200000, 1000).count() == 2
    series = promql.remote_read(water, "h2o_feet", [("location", "=~", "coyote.*")], 1439827200000, 1439827620000).collect()
    assert len(series) == 1 and series[0].labels["location"] == "coyote_creek" and len(series[0].samples) == 3


def test_line_protocol(spark, engine):
    name, tags, fields, t = protocols.parse_line(r'a\ b,t2=y,t1=x\,z f2=1i,f1=2.5,s="q, \"r\"",u=7u,ok=t 1678675992', "s")
    assert (name, tags, t) == ("a b", {"t1": "x,z", "t2": "y"}, 1678675992000)
    assert fields == {"f1": 2.5, "f2": 1, "ok": True, "s": 'q, "r"', "u": ("u", 7)}
    lines = spark.createDataFrame([("demo,tag1=t1,tag2=t2 field1=90,field2=100 1678675992000",), ("demo,tag1=t1,tag2=t2 field1=91,field2=101 1678675993000",), ("demo,tag1=t11,tag2=t22 field1=92,field2=102 1678675992000",), ("# a comment",)], "value string")
    assert protocols.write_lines(engine, protocols.parse_lines(lines)) == 1
    engine.sql("ALTER TABLE demo MODIFY SETTING enable_ttl='false'")
    protocols.write_lines(engine, protocols.parse_lines(lines))
    assert engine.sql("SELECT field1 FROM demo WHERE tag1 = 't1'").count() == 2
    more = spark.createDataFrame([("demo,tag3=z field1=1,field9=3i 1678675999000",)], "value string")
    protocols.write_lines(engine, protocols.parse_lines(more))
    assert engine.sql("SELECT * FROM demo WHERE field9 = 3").count() == 1
    with pytest.raises(SchemaError):
        protocols.write_lines(engine, protocols.parse_lines(spark.createDataFrame([('demo,tag1=a field1="text" 1',)], "value string")))


@pytest.mark.parametrize("body", ["", "{", '{"metric": "", "timestamp": 1700000000, "value": 1, "tags": {"a": "b"}}', '{"metric": "m", "timestamp": 1700000000, "value": 1, "tags": {}}', '{"metric": "m", "timestamp": 1700000000, "value": 1, "tags": {"": "b"}}', '{"metric": "m", "timestamp": 1, "value": 1, "tags": {"a": "b"}}', '{"metric": "m", "timestamp": 10000000000000, "value": 1, "tags": {"a": "b"}}'])
def test_rejected_puts(body):
    with pytest.raises(SchemaError):
        protocols.parse_put(body)


def test_put_and_remote_write(engine):
    import time

    now = int(time.time())
    assert protocols.put(engine, f'{{"metric": "m", "timestamp": {now}, "value": 9527, "tags": {{"host": "web01", "dc": "lga"}}}}') == 1
    assert [c.name for c in engine.meta("m").columns] == ["tsid", "timestamp", "dc", "host", "value"]
    protocols.remote_write(engine, {"timeseries": [{"labels": {"__name__": "m", "host": "web02", "dc": "lga"}, "samples": [[now * 1000, 1], [now * 1000 + 1, 2]]}]})
    assert engine.sql("SELECT value FROM m").count() == 3


def test_streaming_ingest(spark, engine, tmp_path):
    from tidemark.streaming import ingest

    source = tmp_path / "lines"
    source.mkdir()
    (source / "a.txt").write_text("m,t=a v=1 1000\nm,t=b v=2 1000\n")
    engine.sql("CREATE TABLE m (timestamp timestamp NOT NULL TIMESTAMP KEY, t string TAG, v double) WITH (enable_ttl='false')")
    run = lambda: ingest.lines_into_tables(engine, engine.spark.readStream.text(str(source)), str(tmp_path / "cp")).awaitTermination()
    run()
    (source / "b.txt").write_text("m,t=a v=5 1000\n")
    run()
    assert sorted(r.v for r in engine.sql("SELECT v FROM m").collect()) == [2.0, 5.0]
