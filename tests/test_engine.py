import json

import pytest
from pyspark.sql import functions as F

from tidemark.guard import Blocked, Limiter, Priority, deadline, priority_of
from tidemark.schema import SchemaError
from tidemark.sources.storage import Storage, TimeRange, sample_primary_key, sample_segment_ms
from tidemark.sql.dialect import Rewriter
from tidemark.sql.tokens import SqlError, tokenize

OFF = "ENGINE=Analytic WITH (enable_ttl='false')"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_create_describe_show(engine):
    engine.sql(f"CREATE TABLE `t` (c1 int COMMENT 'id', name string TAG, d string DICTIONARY, t timestamp NOT NULL, TIMESTAMP KEY(t)) {OFF}")
    got = rows(engine.sql("DESCRIBE TABLE t"))
    assert got[:2] == [("tsid", "uint64", True, False, False, False), ("t", "timestamp", True, False, False, False)]
    assert ("d", "string", False, True, False, True) in got and ("name", "string", False, True, True, False) in got
    text = engine.sql("SHOW CREATE TABLE t").first()[1]
    assert text.startswith("CREATE TABLE `t` (`tsid` uint64 NOT NULL, `t` timestamp NOT NULL, `c1` int COMMENT 'id', `name` string TAG")
    assert "PRIMARY KEY(tsid,t), TIMESTAMP KEY(t)) ENGINE=Analytic WITH(arena_block_size='2097152'" in text and "enable_ttl='false'" in text
    assert rows(engine.sql("EXISTS TABLE t")) == [(1,)] and rows(engine.sql("EXISTS TABLE u")) == [(0,)]
    assert rows(engine.sql("SHOW TABLES LIKE '_'")) == [("t",)] and rows(engine.sql("SHOW TABLES LIKE 'x%'")) == []
    assert ("public",) in rows(engine.sql("SHOW DATABASES"))
    engine.sql("CREATE TABLE IF NOT EXISTS t (c1 int, t timestamp NOT NULL TIMESTAMP KEY)")
    with pytest.raises(SqlError, match="already exists"):
        engine.sql("CREATE TABLE t (c1 int, t timestamp NOT NULL TIMESTAMP KEY)")
    engine.sql("DROP TABLE t")
    engine.sql("DROP TABLE IF EXISTS t")
    with pytest.raises(SqlError, match="not found"):
        engine.sql("DROP TABLE t")


@pytest.mark.parametrize(
    ("sql", "match"),
    [
        ("CREATE TABLE a (c1 int)", "timestamp constraint"),
        ("CREATE TABLE a (c1 int, t1 timestamp NOT NULL TIMESTAMP KEY, t2 timestamp NOT NULL TIMESTAMP KEY)", "one timestamp key"),
        ("CREATE TABLE a (c1 int, d double DICTIONARY, t timestamp NOT NULL TIMESTAMP KEY)", "dictionaries"),
        ("CREATE TABLE a (c1 int NOT NULL, t timestamp NOT NULL, TIMESTAMP KEY(t), PRIMARY KEY(c1))", "timestamp key"),
        ("CREATE TABLE a (n string TAG, t timestamp NOT NULL TIMESTAMP KEY) PARTITION BY RANDOM PARTITIONS 4", "random"),
        ("CREATE TABLE a (n string TAG, t timestamp NOT NULL TIMESTAMP KEY) PARTITION BY HASH(n) PARTITIONS 4", "hash"),
        ("CREATE TABLE a (n string, t timestamp NOT NULL TIMESTAMP KEY) PARTITION BY KEY(n) PARTITIONS 4", "tag"),
        ("CREATE TABLE a (c decimal, t timestamp NOT NULL TIMESTAMP KEY)", "unsupported type"),
        ("CREATE TABLE a (t timestamp NOT NULL TIMESTAMP KEY) WITH (storage_format='hybrid')", "hybrid"),
        ("DELETE FROM a", "Unsupported"),
        ("SELECT 1; SELECT 2", "one statement"),
    ],
)
def test_rejected_statements(engine, sql, match):
    with pytest.raises(ValueError, match=match):
        engine.sql(sql)


def test_overwrite_replaces_whole_rows_and_append_keeps_all(engine):
    for name, mode in (("o", "OVERWRITE"), ("a", "APPEND")):
        engine.sql(f"CREATE TABLE {name} (timestamp timestamp NOT NULL, value double, dic string dictionary, timestamp KEY (timestamp)) ENGINE=Analytic WITH (enable_ttl='false', update_mode='{mode}')")
        engine.sql(f"INSERT INTO {name} (timestamp, value, dic) VALUES (1, +10, \"d1\"), (2, 0, \"d2\"), (3, -30, \"d1\")")
        assert rows(engine.sql(f"INSERT INTO {name} (timestamp, value) VALUES (1, 100), (2, 200), (3, 300)")) == [(3,)]
    assert sorted(rows(engine.sql("SELECT value, dic FROM o"))) == [(100.0, None), (200.0, None), (300.0, None)]
    assert engine.sql("SELECT * FROM a").count() == 6
    # a value filter doesn't bring replaced rows back
    assert rows(engine.sql("SELECT value FROM o WHERE value < 50")) == []
    assert rows(engine.sql("SELECT value FROM a WHERE value < 0")) == [(-30.0,)]


def test_last_row_of_one_insert_wins(engine):
    engine.sql(f"CREATE TABLE w (t timestamp NOT NULL TIMESTAMP KEY, v int) {OFF}")
    engine.sql("INSERT INTO w (t, v) VALUES (1, 1), (1, 2), (1, 3)")
    assert rows(engine.sql("SELECT v FROM w")) == [(3,)]
    engine.sql(f"CREATE TABLE x (t timestamp NOT NULL TIMESTAMP KEY, h string TAG, v int) {OFF}")
    engine.sql("INSERT INTO x (t, h, v) VALUES " + ", ".join(f"({i % 2}, 'h{i % 3}', {i})" for i in range(60)))
    assert sorted(rows(engine.sql("SELECT v FROM x"))) == [(i,) for i in range(54, 60)]


def test_defaults_in_order(engine):
    engine.sql(f"CREATE TABLE d (timestamp timestamp NOT NULL TIMESTAMP KEY, c1 uint32, c2 string default '123', c3 uint32 default c1 + 1, c4 uint32 default c3 + 1, c5 uint32 default c3 + 10, c6 string default \"default\") {OFF}")
    engine.sql("INSERT INTO d (timestamp, c1, c5) VALUES (1, 10, 3), (2, 20, 4)")
    assert rows(engine.sql("SELECT c1, c2, c3, c4, c5, c6 FROM d ORDER BY c1")) == [(10, "123", 11, 12, 3, "default"), (20, "123", 21, 22, 4, "default")]


@pytest.mark.parametrize(
    "sql", ["INSERT INTO i (t, v) VALUES (1, NULL)", "INSERT INTO i (tsid, t) VALUES (1, 1)", "INSERT INTO i (t, t) VALUES (1, 1)", "INSERT INTO i (t, nothing) VALUES (1, 1)", "INSERT INTO i (v) VALUES (1)", "INSERT INTO i (t, v) VALUES (1, 300)", "INSERT INTO i (t) SELECT 1"]
)
def test_rejected_inserts(engine, sql):
    engine.sql(f"CREATE TABLE i (t timestamp NOT NULL TIMESTAMP KEY, v tinyint) {OFF}")
    with pytest.raises(ValueError, match=r"."):
        engine.sql(sql).collect()


def test_alter(engine):
    engine.sql(f"CREATE TABLE al (a int, t timestamp NOT NULL TIMESTAMP KEY) {OFF}")
    engine.sql("INSERT INTO al (a, t) VALUES (1, 1)")
    engine.sql("ALTER TABLE al ADD COLUMN (b string, c double)")
    engine.sql("ALTER TABLE al ADD COLUMN d string dictionary")
    engine.sql("INSERT INTO al (a, b, t) VALUES (2, '2', 2)")
    assert rows(engine.sql("SELECT a, b, d FROM al ORDER BY a")) == [(1, None, None), (2, "2", None)]
    for bad in ("ALTER TABLE al RENAME TO x", "ALTER TABLE al DROP COLUMN b", "ALTER TABLE al ADD COLUMN e int NOT NULL", "ALTER TABLE al ADD COLUMN b int", "ALTER TABLE al MODIFY SETTING update_mode='APPEND'"):
        with pytest.raises(ValueError, match=r"."):
            engine.sql(bad)
    engine.sql("ALTER TABLE al MODIFY SETTING ttl='10d'")
    assert "ttl='10d'" in engine.sql("SHOW CREATE TABLE al").first()[1]


def test_types_and_unsigned_arithmetic(engine):
    engine.sql(f"CREATE TABLE ty (t timestamp NOT NULL TIMESTAMP KEY, d double, f float, s string, b varbinary, u64 uint64, u8 uint8, i64 int64, bo boolean, u2 bigint unsign) {OFF}")
    engine.sql("INSERT INTO ty (t, d, f, s, b, u64, u8, i64, bo, u2) VALUES (1651737067000, 100, 100, 's', x'11', 10, 100, 100, false, 18446744073709551615), (1651737067001, 100, 100, 's', 'v', 0, 100, 100, true, 1)")
    r = engine.sql("SELECT min(u64) - max(u64) AS w, sum(i64 / 3) AS q FROM ty").first()
    assert (int(r.w), r.q) == (18446744073709551606, 66)
    assert engine.sql("SELECT * FROM ty WHERE b = x'11'").count() == 1
    assert engine.sql("SELECT * FROM ty WHERE bo = 'true'").count() == 1
    assert engine.sql("SELECT * FROM ty WHERE t BETWEEN 1651737067000 AND 1651737067000").count() == 1
    assert engine.sql("SELECT * FROM ty WHERE t IN (1651737067000, 1651737067001)").count() == 2
    with pytest.raises(SqlError):
        engine.sql("SELECT * FROM ty WHERE i64 = 'abc'")


def test_dialect_text():
    text = lambda s: Rewriter(tokenize(s), lambda n: None).spark_sql({})
    assert "NULLS LAST" in text("select a from t order by a") and "NULLS FIRST" in text("select a from t order by a desc")
    assert text("select 7 / 2") == "select 7 DIV 2"
    assert "RLIKE '(?i)a'" in text("select a from t where a ~* 'a'") and "NOT RLIKE" in text("select a from t where a !~ 'a'")
    assert "percentile(v, 0.9)" in text("select approx_percentile_cont(v, 0.9) from t")


def test_case_sensitive_names(engine):
    engine.sql(f"CREATE TABLE `Case_T` (ts timestamp NOT NULL TIMESTAMP KEY, VALUE1 double) {OFF}")
    engine.sql("INSERT INTO Case_T (ts, VALUE1) VALUES (1, 10)")
    assert rows(engine.sql("SELECT VALUE1 FROM Case_T")) == [(10.0,)]
    with pytest.raises(Exception, match=r"(?i)case_t"):
        engine.sql("SELECT * FROM case_t")
    with pytest.raises(Exception, match="value1"):
        engine.sql("SELECT value1 FROM Case_T")


def test_key_partitions_prune(engine):
    engine.sql("CREATE TABLE p (t timestamp NOT NULL TIMESTAMP KEY, name string TAG, id int TAG, value double NOT NULL) PARTITION BY KEY(name) PARTITIONS 4 ENGINE=Analytic WITH (enable_ttl='false', update_mode='APPEND')")
    values = ", ".join(f"(1651737067000, 'n{i}', {i}, {100 + i})" for i in range(11))
    engine.sql(f"INSERT INTO p (t, name, id, value) VALUES {values}")
    assert rows(engine.sql("SELECT value FROM p WHERE name = 'n3'")) == [(103.0,)]
    storage = engine.storage("p")
    assert len(storage.partitions({"name": {"n3"}})) == 1 and storage.partitions({"id": {1}}) is None
    plan = engine.sql("EXPLAIN SELECT value FROM p WHERE name = 'n3'").first().plan
    assert "__part" in plan
    assert sum(engine.scan(f"__p_{i}").count() for i in range(4)) == 11
    assert engine.sql("SELECT approx_percentile_cont(value, 0.9) AS p FROM p").first().p == pytest.approx(109.0)


def test_key_filters_reach_the_scan_but_value_filters_do_not(engine):
    engine.sql(f"CREATE TABLE f (t timestamp NOT NULL TIMESTAMP KEY, name string TAG, v double) {OFF}")
    engine.sql("INSERT INTO f (t, name, v) VALUES (1, 'a', 1), (2, 'b', 2)")
    pushed = lambda sql: engine.sql(sql)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(name), EqualTo(name,a)" in pushed("SELECT v FROM f WHERE name = 'a'")
    assert "GreaterThan(v" not in pushed("SELECT v FROM f WHERE v > 1")


def test_segments_ttl_and_compaction(spark, engine):
    day = 86_400_000
    engine.now_ms = 30 * day
    engine.sql("CREATE TABLE s (t timestamp NOT NULL TIMESTAMP KEY, v int) ENGINE=Analytic WITH (ttl='7d', segment_duration='1d')")
    engine.sql(f"INSERT INTO s (t, v) VALUES ({20 * day}, 1), ({25 * day}, 2), ({29 * day}, 3)")
    engine.sql(f"INSERT INTO s (t, v) VALUES ({25 * day}, 4)")
    storage = engine.storage("s")
    assert rows(engine.sql("SELECT v FROM s ORDER BY v")) == [(3,), (4,)]
    assert [n for n in storage.folder.list("data") if n.startswith("__seg")] == ["__seg=25", "__seg=29"]
    assert storage.files().count() == 3
    assert sorted((r.rows, r.first) for r in storage.file_stats().collect()) == [(1, 25 * day), (1, 25 * day), (1, 29 * day)]
    storage.compact(now_ms=33 * day)
    assert storage.files().count() == 1 and rows(engine.sql("SELECT v FROM s")) == [(3,)]


def test_point_get(engine):
    engine.sql(f"CREATE TABLE g (t timestamp NOT NULL TIMESTAMP KEY, name string TAG, v int) {OFF}")
    engine.sql("INSERT INTO g (t, name, v) VALUES (1, 'a', 1), (1, 'b', 2)")
    assert rows(engine.storage("g").get({"t": 1, "name": "b"}, ["v"])) == [(2,)]
    with pytest.raises(SchemaError):
        engine.storage("g").get({"name": "a"})


def test_samplers(spark):
    df = spark.range(1000).select(F.timestamp_millis(F.col("id") * 300_000).alias("t"), F.lit("a").alias("s"))
    assert sample_segment_ms(df, "t", ["s"]) == 86_400_000  # a hundred intervals are over eight hours
    from tidemark.schema import ColumnMeta, make_table

    meta = make_table("x", [ColumnMeta("t", "timestamp"), ColumnMeta("a", "int"), ColumnMeta("b", "int"), ColumnMeta("c", "string")], "t")
    data = spark.range(100).select((F.col("id") % 3).cast("int").alias("a"), F.col("id").cast("int").alias("b"), F.lit("k").alias("c"))
    assert sample_primary_key(data, meta) == ["c", "a", "tsid", "t"]


def test_memory_engine_and_system_table(engine):
    engine.sql("CREATE TABLE m (t timestamp NOT NULL TIMESTAMP KEY, v int) ENGINE=Memory")
    engine.sql("INSERT INTO m (t, v) VALUES (1, 1)")
    assert rows(engine.sql("SELECT v FROM m")) == [(1,)]
    assert [r.table_name for r in engine.tables_frame().collect()] == ["m"]
    assert engine.to_rows(engine.sql("SELECT t, v FROM m")) == {"rows": [{"t": 1, "v": 1}]}
    assert engine.collect_once("SELECT v FROM m")[0].v == 1


def test_guards(spark, engine):
    assert priority_of(TimeRange(0, 1000)) is Priority.HIGH and priority_of(TimeRange(0, None)) is Priority.LOW and priority_of(TimeRange(5, 5)) is Priority.EMPTY
    engine.sql(f"CREATE TABLE q (t timestamp NOT NULL TIMESTAMP KEY, v int) {OFF}")
    engine.sql("INSERT INTO q (t, v) VALUES (1, 1)")
    assert engine.sql("SELECT v FROM q WHERE t > 5 AND t < 3").count() == 0
    engine.limiter = Limiter(rules=["query_without_predicate", ("query_range", 1000)])
    assert engine.sql("SELECT v FROM q WHERE t >= 0 AND t < 10").count() == 1
    for bad in ("SELECT v FROM q", "SELECT v FROM q WHERE t > 0"):
        with pytest.raises(Blocked):
            engine.sql(bad)
    engine.limiter = Limiter(block_reads={"q"}, block_writes={"q"})
    with pytest.raises(Blocked):
        engine.sql("SELECT v FROM q WHERE t = 1")
    with pytest.raises(Blocked):
        engine.sql("INSERT INTO q (t, v) VALUES (2, 1)")
    with deadline(spark, 60):
        assert spark.range(3).count() == 3


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("t = 5", (5, 6)), ("t > 5 AND t <= 9", (6, 10)), ("t BETWEEN 5 AND 9", (5, 10)), ("t IN (3, 9)", (3, 10)), ("t < 5 OR t > 7", (None, None)), ("t = 2 OR t = 8", (2, 9)),
        ("t != 5", (None, None)), ("NOT t > 5", (None, None)), ("(t >= 1 AND t < 4) AND v = 2", (1, 4)), ("v = 1 OR t = 5", (None, None)),
    ],
)
def test_time_range_of_conditions(engine, where, want):
    from tidemark.schema import ColumnMeta, make_table

    meta = make_table("z", [ColumnMeta("t", "timestamp"), ColumnMeta("v", "int")], "t")
    span, _ = Rewriter(tokenize(f"SELECT v FROM z WHERE {where} ORDER BY v"), lambda n: meta).asked(meta)
    assert (span.start, span.end) == want


def test_meta_survives_json(engine):
    engine.sql("CREATE TABLE j (t timestamp NOT NULL TIMESTAMP KEY, n string TAG) PARTITION BY KEY(n) PARTITIONS 2 WITH (update_mode='APPEND')")
    meta = engine.meta("j")
    assert type(meta).from_json(json.loads(json.dumps(meta.to_json()))) == meta
    assert isinstance(engine.storage("j"), Storage)


def test_batches_are_written_once(spark, engine):
    df = spark.createDataFrame([(1_700_000_000_000, "a", 1.0), (1_700_000_000_000, "b", 2.0)], "timestamp long, n string, v double").withColumn("timestamp", F.timestamp_millis("timestamp"))
    engine.now_ms = 1_700_000_000_000
    for _ in range(2):
        engine.ingest("w", df, ["n"], batch=5)
    storage = engine.storage("w")
    assert storage.files().count() == 2
    storage.folder.delete("_batches/5.done")  # as if the writer had died after its files were there
    engine.ingest("w", df, ["n"], batch=5)
    assert storage.files().count() == 2 and storage.folder.exists("_batches/5.done")
    engine.ingest("w", df, ["n"], batch=6)
    assert storage.files().count() == 4


def test_compaction_is_one_step(spark, engine, monkeypatch):
    engine.sql(f"CREATE TABLE k (t timestamp NOT NULL TIMESTAMP KEY, n string TAG, v int) {OFF}")
    for v in (1, 2):
        engine.sql(f"INSERT INTO k (t, n, v) VALUES (1, 'a', {v}), (2, 'b', {v})")
    storage, before = engine.storage("k"), engine.storage("k").data
    real = type(storage)._rewritten

    def meanwhile(self, df):
        engine.sql("INSERT INTO k (t, n, v) VALUES (3, 'c', 3)")
        return real(self, df)

    monkeypatch.setattr(type(storage), "_rewritten", meanwhile)
    with pytest.raises(SchemaError, match="written to"):
        storage.compact()
    monkeypatch.undo()
    assert storage.data == before and sorted(rows(engine.sql("SELECT v FROM k"))) == [(2,), (2,), (3,)]
    storage.compact()
    assert storage.data != before and not storage.folder.exists(before) and storage.files().count() == 3
    assert sorted(rows(engine.sql("SELECT v FROM k"))) == [(2,), (2,), (3,)]


def test_explain_analyze_runs(engine):
    engine.sql(f"CREATE TABLE x (t timestamp NOT NULL TIMESTAMP KEY, v int) {OFF}")
    engine.sql("INSERT INTO x (t, v) VALUES (1, 1), (2, 2)")
    assert "output_rows=2" in engine.sql("EXPLAIN ANALYZE SELECT v FROM x").first().plan
