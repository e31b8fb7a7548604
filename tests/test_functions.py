import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing, scalars, timeseries
from tidemark.functions.registry import Registry, Signature, default_registry, register_udf

TIMES = [1659577423000, 1659577422000, 1659577320000, 1659571200000, 1659484800000, 1656777600000]


def test_murmur_of_known_strings():
    assert hashing.murmur64(b"") == 0
    assert hashing.murmur64(b"hello") == 0xCBD8A7B341BD9B02


def test_series_id_of_mixed_tags():
    tags = [(3, "string", "t1"), (4, "int", 1), (5, "varbinary", b"v1")]
    assert hashing.series_id(tags) == 15527369105987057363


def test_series_id_skips_nulls_and_is_zero_without_tags():
    assert hashing.series_id([]) == 0
    assert hashing.series_id([(3, "string", None)]) == 0
    assert hashing.series_id([(3, "string", "a"), (4, "string", None)]) == hashing.series_id([(3, "string", "a")])


def test_series_id_column(spark):
    df = spark.createDataFrame([("below 3 feet", "santa_monica"), ("between 6 and 9 feet", "coyote_creek"), (None, None), ("below 3 feet", "santa_monica")], "level string, place string")
    rows = hashing.with_series_id(df, [(3, "string", "level"), (4, "string", "place")]).collect()
    got = {r.place: int(r.tsid) for r in rows}
    assert got == {"santa_monica": 8247797837995683878, "coyote_creek": 4483051411356144610, None: 0}
    assert len(rows) == 4


def test_varints():
    assert hashing.uvarint(300) == b"\xac\x02"
    assert hashing.varint(-1) == b"\x01" and hashing.varint(1) == b"\x02"


def test_key_partition_is_stable_on_columns(spark):
    df = spark.createDataFrame([(f"n{i}",) for i in range(50)], "name string")
    for r in hashing.with_partition(df, [("string", "name")], 4).collect():
        assert r["__part"] == hashing.key_partition([("string", r.name)], 4)


@pytest.mark.parametrize(
    ("period", "want"),
    [
        ("P1Y", [1640966400000] * 6),
        ("P1M", [1659283200000] * 5 + [1656604800000]),
        ("P1W", [1657756800000] * 5 + [1652918400000]),
        ("P1D", [1659542400000] * 4 + [1659456000000, 1656777600000]),
        ("PT1H", [1659574800000] * 3 + [1659571200000, 1659484800000, 1656777600000]),
    ],
)
def test_time_bucket(spark, period, want):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TIMES)], "i int, t long").select("i", F.timestamp_millis("t").alias("ts"))
    got = [r.b for r in df.select("i", F.unix_millis(timeseries.time_bucket("ts", period)).alias("b")).orderBy("i").collect()]
    assert got == want


def test_time_bucket_truncates_toward_zero_and_keeps_null(spark):
    df = spark.sql("select timestamp_millis(-1500) as a, cast(null as timestamp) as b")
    r = df.select(F.unix_millis(timeseries.time_bucket("a", "PT1S")).alias("a"), timeseries.time_bucket("b", "PT1S").alias("b")).first()
    assert (r.a, r.b) == (-1000, None)


@pytest.mark.usefixtures("spark")
@pytest.mark.parametrize("period", ["PT0S", "P2W", "P3M", "1H", "PT70000S"])
def test_time_bucket_rejects(period):
    with pytest.raises(ValueError, match="period"):
        timeseries.time_bucket(F.col("ts"), period)


def test_date_bin(spark):
    r = spark.sql("select timestamp_millis(1659577423000) as t").select(F.unix_millis(timeseries.date_bin(900_000, "t")).alias("a"), F.unix_millis(timeseries.date_bin(7_200_000, "t", 3_600_000)).alias("b")).first()
    assert (r.a, r.b) == (1659577423000 // 900000 * 900000, (1659577423000 - 3600000) // 7200000 * 7200000 + 3600000)


def test_scalars_against_python(spark):
    import math

    rng = random.Random(1)
    pairs = [(rng.randrange(0, 10**6), rng.randrange(0, 10**6)) for _ in range(40)] + [(0, 5), (7, 0), (0, 0)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for r in df.select("a", "b", scalars.gcd(F.col("a"), F.col("b")).alias("g"), scalars.lcm(F.col("a"), F.col("b")).alias("l"), scalars.to_hex(F.col("a")).alias("h")).collect():
        assert (r.g, r.l, r.h) == (math.gcd(r.a, r.b), math.lcm(r.a, r.b), f"{r.a:x}")


def test_distinct_sketch_is_close(spark):
    got = spark.range(20000).select((F.col("id") % 5000).alias("x")).agg(timeseries.thetasketch_distinct("x").alias("n")).first().n
    assert abs(got - 5000) / 5000 < 0.03


def test_registry(spark):
    r = default_registry()
    assert "time_bucket" in r.names()
    with pytest.raises(ValueError, match="already"):
        r.register("time_bucket", timeseries.time_bucket)
    with pytest.raises(KeyError):
        r.find("nothing")
    s = Signature(one_of=(Signature(exact=("int", "string")), Signature(uniform=(2, ("double",)))))
    assert s.accepts(["int", "string"]) and s.accepts(["double", "double"]) and not s.accepts(["int", "int"])
    own = Registry()
    register_udf(spark, own, "plus_one", lambda x: x + 1, "long")
    assert spark.range(3).select(own.find("plus_one")("id").alias("y")).agg(F.sum("y")).first()[0] == 6


def test_label_matchers(spark):
    df = spark.createDataFrame([("abc",), ("ab",), (None,)], "x string")
    count = lambda op, v: df.where(timeseries.label_match("x", op, v)).count()
    assert (count("=", "ab"), count("!=", "ab"), count("=~", "ab"), count("=~", "ab.*"), count("!~", "ab")) == (1, 1, 1, 2, 1)
    assert df.where(timeseries.regex_match("x", "b")).count() == 2
