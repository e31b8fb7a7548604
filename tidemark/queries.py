"""Named queries over the supplied tables: one or more for each operator, with SQL for the same rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import Engine
from .functions import scalars, timeseries
from .plans import influxql, opentsdb, promql
from .schema import ColumnMeta, make_table
from .session import engine_session
from .sources.storage import last_write

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name: text that Spark and DuckDB both read.
BOTH = {
    "f1_projection_arithmetic": "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net, l_quantity + 1 as q1 from lineitem",
    "f2_filter_and_or_not": "select o_orderkey, o_totalprice from orders where (o_totalprice > 200000 or o_orderstatus = 'F') and not (o_orderpriority = '1-URGENT')",
    "f3_between_in": "select l_orderkey, l_linenumber from lineitem where l_quantity between 10 and 20 and l_linenumber in (1, 3, 5) and l_returnflag not in ('N') and l_tax not between 0.03 and 0.05",
    "f4_like_case_cast": "select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as size_class, cast(floor(p_retailprice) as bigint) as price from part where p_name like '%a%' and p_type is not null",
    "f4_try_cast_distinct_from": "select user_id, try_cast(event_type as bigint) as n, (event_type is distinct from 'click') as other from events",
    "f13_select_distinct": "select distinct o_orderstatus, o_orderpriority from orders",
    "f14_scalar_subquery": "select c_custkey, c_acctbal from customer where c_acctbal > (select avg(c_acctbal) from customer)",
    "f14_in_exists_subquery": "select c_custkey, c_name from customer c where c_nationkey in (select n_nationkey from nation where n_regionkey = 1) and exists (select 1 from orders o where o.o_custkey = c.c_custkey)",
    "f14_not_exists": "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)",
    "f14_correlated_scalar": "select o_orderkey from orders o where o_totalprice > (select avg(i.o_totalprice) from orders i where i.o_custkey = o.o_custkey)",
    "f15_cte": "with big as (select o_custkey, count(*) as n from orders group by o_custkey), top as (select * from big where n > 5) select c.c_name, t.n from top t join customer c on c.c_custkey = t.o_custkey",
    "s13_no_from": "select 1 as one, 2 + 3 * 4 as fourteen",
    "j1_inner_join": "select o.o_orderkey, l.l_linenumber, o.o_orderpriority from orders o join lineitem l on o.o_orderkey = l.l_orderkey where o.o_totalprice > 300000",
    "j1_left_join": "select c.c_custkey, count(o.o_orderkey) as n from customer c left join orders o on c.c_custkey = o.o_custkey group by c.c_custkey",
    "j1_right_join": "select o.o_orderkey, c.c_name from customer c right join orders o on c.c_custkey = o.o_custkey and c.c_acctbal > 0",
    "j1_full_join": "select coalesce(c.c_nationkey, s.s_nationkey) as nation, c.n as customers, s.n as suppliers from (select c_nationkey, count(*) as n from customer group by c_nationkey) c full outer join (select s_nationkey, count(*) as n from supplier group by s_nationkey) s on c.c_nationkey = s.s_nationkey",
    "j2_anti_by_not_in": "select s_suppkey from supplier where s_suppkey not in (select l_suppkey from lineitem where l_quantity > 49)",
    "j3_cross_join": "select r_name, n_name from region cross join nation",
    "j4_theta_join": "select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_regionkey < b.n_regionkey and a.n_nationkey > b.n_nationkey",
    "j5_natural_join": "select n_name, c from nation natural join (select c_nationkey as n_nationkey, count(*) as c from customer group by c_nationkey) k",
    "j5_using_join": "select k, o, l from (select o_orderkey as k, o_totalprice as o from orders) a join (select l_orderkey as k, count(*) as l from lineitem group by l_orderkey) b using (k)",
    "j6_multi_join": "select n.n_name, r.r_name, count(*) as orders, cast(round(sum(o.o_totalprice), 0) as bigint) as total from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by n.n_name, r.r_name",
    "a1_aggregates": "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty, round(avg(l_extendedprice) + 0.0000001, 4) as price, min(l_discount) as lo, max(l_tax) as hi from lineitem group by l_returnflag, l_linestatus",
    "a2_count_distinct": "select o_orderstatus, count(distinct o_custkey) as customers, count(distinct o_orderpriority) as priorities from orders group by o_orderstatus",
    "a3_group_expr_having": "select p_size % 5 as bucket, count(*) as n, max(p_retailprice) as top from part group by p_size % 5 having count(*) > 10",
    "a4_global_aggregate": "select count(*) as n, count(distinct user_id) as users, round(sum(value), 2) as total from events",
    "a12_grouping_sets": "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "a12_rollup": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)",
    "a12_cube": "select event_type, user_id % 3 as g, count(*) as n from events group by cube (event_type, user_id % 3)",
    "a13_filter_clause": "select event_type, count(*) filter (where value > 50) as large, round(sum(value) filter (where user_id % 2 = 0), 2) as even from events group by event_type",
    "a11_bit_bool": "select o_orderstatus, bit_and(o_custkey) as a, bit_or(o_custkey) as o, bit_xor(o_custkey) as x, bool_and(o_totalprice > 0) as every, bool_or(o_totalprice > 400000) as some_ from orders group by o_orderstatus",
    "a10_regressions": "select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as c, round(covar_samp(l_quantity, l_discount), 6) as cs, round(covar_pop(l_quantity, l_discount), 6) as cp, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_r2(l_extendedprice, l_quantity), 6) as r2, regr_count(l_tax, l_quantity) as n, round(regr_avgx(l_tax, l_quantity), 4) as ax, round(regr_avgy(l_tax, l_quantity), 6) as ay from lineitem group by l_returnflag",
    "a10_regr_sums": "select l_linestatus, round(regr_intercept(l_extendedprice, l_quantity), 3) as b, round(regr_sxx(l_tax, l_quantity), 2) as sxx, round(regr_syy(l_tax, l_quantity), 4) as syy, round(regr_sxy(l_tax, l_quantity), 3) as sxy from lineitem group by l_linestatus",
    "a10_deviations": "select event_type, round(stddev(value), 6) as s, round(stddev_pop(value), 6) as sp, round(var_samp(value), 4) as v, round(var_pop(value), 4) as vp from events group by event_type",
    "a9_median": "select event_type, median(value) as med from events group by event_type",
    "w1_ranking": "select o_orderkey, row_number() over w as rn, rank() over w as rk, dense_rank() over w as dr, ntile(4) over w as q, round(percent_rank() over w, 6) as pr, round(cume_dist() over w, 6) as cd from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)",
    "w2_offsets": "select event_id, lag(value) over w as before, lead(value, 2) over w as after2, first_value(value) over w as head, nth_value(value, 2) over (partition by user_id order by event_id rows between unbounded preceding and unbounded following) as second from events window w as (partition by user_id order by event_id)",
    "w3_rows_frame": "select event_id, round(sum(value) over (partition by user_id order by event_id rows between 3 preceding and current row), 4) as s, count(*) over (partition by user_id order by event_id rows between 1 preceding and 1 following) as n from events",
    "w3_range_frame": "select o_orderkey, count(*) over (partition by o_custkey order by o_totalprice range between 50000 preceding and current row) as near from orders",
    "o2_top_k": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10",
    "o2_limit_offset": "select c_custkey from customer order by c_custkey limit 20 offset 15",
    "t1_union_all": "select n_nationkey as k from nation union all select s_nationkey from supplier",
    "t1_union": "select n_nationkey as k from nation union select c_nationkey from customer",
    "t2_intersect": "select c_nationkey as k from customer intersect select s_nationkey from supplier",
    "t2_except": "select c_custkey as k from customer except select o_custkey from orders",
    "t2_intersect_all": "select c_nationkey as k from customer intersect all select s_nationkey from supplier",
    "t2_except_all": "select c_nationkey as k from customer except all select s_nationkey from supplier",
    "x_math_functions": "select event_id, abs(-value) as a, round(sqrt(value), 6) as s, cast(ceil(value) as bigint) as c, cast(floor(value) as bigint) as f, round(ln(value + 1), 6) as l, round(log10(value + 1), 6) as l10, round(power(value, 2), 2) as p, round(exp(value / 1000), 6) as e, cast(sign(value - 5) as int) as sg, round(sin(value), 6) as si, round(atan2(value, 2), 6) as at, round(degrees(1.0 + user_id), 4) as dg, round(cbrt(value), 6) as cb from events",
    "x_string_functions": "select c_custkey, upper(c_name) as u, length(c_name) as n, substring(c_name, 2, 3) as s, replace(c_name, '0', 'o') as r, reverse(c_mktsegment) as rv, lpad(c_mktsegment, 12, '*') as lp, trim(concat(' ', c_name, ' ')) as t, left(c_name, 4) as lf, concat_ws('-', c_name, c_mktsegment) as cw, split_part(c_name, '#', 1) as sp, translate(c_name, 'abc', 'xyz') as tr, repeat('ab', 2) as rp, ascii(c_name) as ac from customer",
    "x_conditional": "select o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') as s, case o_orderpriority when '1-URGENT' then 1 else 0 end as u from orders",
}

#: name: (Spark SQL, DuckDB SQL)
EACH = {
    "f5_regex_bitwise": (
        "select c_custkey, c_custkey & 7 as a, c_custkey | 8 as o, c_custkey ^ 5 as x, shiftleft(c_custkey, 2) as l, shiftright(c_custkey, 1) as r, c_name || '!' as e from customer where c_mktsegment rlike '^(?i)[ab]'",
        "select c_custkey, c_custkey & 7 as a, c_custkey | 8 as o, xor(c_custkey, 5) as x, c_custkey << 2 as l, c_custkey >> 1 as r, c_name || '!' as e from customer where regexp_matches(c_mktsegment, '(?i)^[ab]')",
    ),
    "f15_unnest": (
        "select user_id, w from (select user_id, explode(split(event_type, 'i')) as w from events)",
        "select user_id, unnest(string_split(event_type, 'i')) as w from events",
    ),
    "j2_semi_join": (
        "select s_suppkey, s_name from supplier left semi join (select l_suppkey from lineitem where l_quantity > 49) l on s_suppkey = l.l_suppkey",
        "select s_suppkey, s_name from supplier where s_suppkey in (select l_suppkey from lineitem where l_quantity > 49)",
    ),
    "j2_anti_join": (
        "select c_custkey from customer left anti join orders on c_custkey = o_custkey",
        "select c_custkey from customer where not exists (select 1 from orders where c_custkey = o_custkey)",
    ),
    "a11_collect_listagg": (
        "select n_regionkey, array_join(array_sort(collect_list(n_name)), ',') as names, min_by(n_name, n_nationkey) as first_name, max_by(n_name, n_nationkey) as last_name from nation group by n_regionkey",
        "select n_regionkey, array_to_string(list_sort(list(n_name)), ',') as names, min_by(n_name, n_nationkey) as first_name, max_by(n_name, n_nationkey) as last_name from nation group by n_regionkey",
    ),
    "a11_grouping": (
        "select o_orderstatus, cast(grouping(o_orderstatus) as bigint) as g, count(*) as n from orders group by rollup (o_orderstatus)",
        "select o_orderstatus, cast(grouping(o_orderstatus) as bigint) as g, count(*) as n from orders group by rollup (o_orderstatus)",
    ),
    "a7_percentile_cont": (
        "select event_type, round(percentile(value, 0.9), 6) as p90, round(percentile(value, 0.25), 6) as p25 from events group by event_type",
        "select event_type, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.25), 6) as p25 from events group by event_type",
    ),
    "a8_percentile_weighted": (
        "select l_returnflag, percentile(l_linenumber, 0.5, cast(l_quantity as int)) as p from lineitem group by l_returnflag",
        "with r as (select l_returnflag, l_linenumber from (select l_returnflag, l_linenumber, unnest(range(cast(l_quantity as int))) from lineitem)) select l_returnflag, quantile_cont(l_linenumber, 0.5) as p from r group by l_returnflag",
    ),
    "x_date_functions": (
        "select event_id, year(ts) as y, month(ts) as m, day(ts) as d, hour(ts) as h, cast(date_format(date_trunc('month', ts), 'yyyy-MM-dd') as string) as mon, dayofweek(ts) - 1 as dow, unix_micros(cast(ts as timestamp)) as us, quarter(ts) as q from events",
        "select event_id, year(ts)::int as y, month(ts)::int as m, day(ts)::int as d, hour(ts)::int as h, strftime(date_trunc('month', ts), '%Y-%m-%d') as mon, dayofweek(ts)::int as dow, epoch_us(ts) as us, quarter(ts)::int as q from events",
    ),
    "x_binary_encoding": (
        "select c_custkey, base64(cast(c_name as binary)) as b, lower(hex(c_name)) as h, bit_length(c_name) as n from customer",
        "select c_custkey, to_base64(encode(c_name)) as b, lower(hex(c_name)) as h, bit_length(c_name)::int as n from customer",
    ),
    "x_regex_functions": (
        "select c_custkey, regexp_replace(c_name, '[0-9]', '#') as r, regexp_extract(c_name, '([0-9]+)', 1) as d, regexp_count(c_name, '0') as n from customer",
        "select c_custkey, regexp_replace(c_name, '[0-9]', '#', 'g') as r, regexp_extract(c_name, '([0-9]+)', 1) as d, len(regexp_extract_all(c_name, '0'))::int as n from customer",
    ),
    "x_array_functions": (
        "select event_id, size(a) as n, array_contains(a, 7) as has7, array_join(transform(a, x -> cast(x as string)), '-') as s, element_at(a, 1) as head, array_join(transform(array_sort(array_distinct(concat(a, array(7L)))), x -> cast(x as string)), ',') as u from (select event_id, array(user_id, event_id % 10, 7L) as a from events)",
        "select event_id, len(a)::int as n, list_contains(a, 7) as has7, array_to_string(a, '-') as s, a[1] as head, array_to_string(list_sort(list_distinct(a || [7])), ',') as u from (select event_id, [user_id, event_id % 10, 7] as a from events)",
    ),
    "x_hash_functions": ("select c_custkey, md5(c_name) as m, sha2(c_name, 256) as s from customer", "select c_custkey, md5(c_name) as m, sha256(c_name) as s from customer"),
    "x_levenshtein_position": (
        "select c_custkey, levenshtein(c_mktsegment, 'MACHINE') as d, instr(c_name, '#') as p, find_in_set('b', 'a,b,c') as f, initcap(lower(c_mktsegment)) as i, chr(65) as c from customer",
        "select c_custkey, levenshtein(c_mktsegment, 'MACHINE')::int as d, instr(c_name, '#')::int as p, 2::int as f, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as i, chr(65) as c from customer",
    ),
}

# ---- time series over events --------------------------------------------------------------

#: Keeps means off the middle between two roundings, which engines round differently.
NUDGE = 1e-7
#: A grid of days, with windows of two days.
START, END, STEP, RANGE = 1704412800000, 1706140800000, 86_400_000, 172_800_000
_SERIES = "s as (select event_type, (epoch_us(ts) // 1000) as t, value as v from events), g as (select unnest(generate_series({start}, {end}, {step})) as gt)".format(start=START, end=END, step=STEP)
_WINDOWS = f"{_SERIES}, w as (select event_type, gt, list(struct_pack(t := t, v := v) order by t, v) as l from s join g on t between gt - {RANGE} and gt group by event_type, gt)"


def _extrapolated(counter: bool, rate: bool) -> str:
    drops = "+ list_sum([case when l[i].v < l[i - 1].v then l[i - 1].v else 0 end for i in range(2, len(l) + 1)])" if counter else ""
    head = f"case when {'true' if counter else 'false'} and diff > 0 and l[1].v >= 0 then least((l[1].t - (gt - {RANGE}))::double, len_ * l[1].v / diff) else (l[1].t - (gt - {RANGE}))::double end"
    return f"""with {_WINDOWS}, d as (select *, l[-1].v - l[1].v {drops} as diff, (l[-1].t - l[1].t)::double as len_, (l[-1].t - l[1].t)::double / (len(l) - 1) as av from w where len(l) >= 2),
      e as (select *, {head} as hd, (gt - l[-1].t)::double as tl from d)
      select event_type, gt::bigint as ts, round(diff * (len_ + case when hd > 1.1 * av then av / 2 else hd end + case when tl > 1.1 * av then av / 2 else tl end) / len_ {f'/ {RANGE / 1000}' if rate else ''}, 6) as value from e"""


PROM_ORACLE = {
    "prom_instant": f"with {_SERIES} select event_type, gt::bigint as ts, round(arg_max(v, t), 6) as value from s join g on t between gt - {RANGE} and gt group by event_type, gt",
    "prom_rate": _extrapolated(True, True), "prom_increase": _extrapolated(True, False), "prom_delta": _extrapolated(False, False),
    "prom_irate": f"with {_WINDOWS} select event_type, gt::bigint as ts, round(case when l[-1].v < l[-2].v then l[-1].v else l[-1].v - l[-2].v end / ((l[-1].t - l[-2].t) / 1000.0), 6) as value from w where len(l) >= 3",
    "prom_idelta": f"with {_WINDOWS} select event_type, gt::bigint as ts, round(l[-1].v - l[-2].v, 6) as value from w where len(l) >= 3",
}


def session(spark: SparkSession, sf_dir: str) -> SparkSession:
    """A session with the engine's settings and a view of each table."""
    s = engine_session(spark)
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        try:
            s.read.parquet(path).createOrReplaceTempView(t)
        except Exception as e:  # a folder may lack tables
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return s


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return engine_session(spark).read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def events_engine(spark: SparkSession, sf_dir: str, overwrite: bool = False) -> Engine:
    """An engine with one table in memory: events by type, as a series each."""
    engine = Engine(spark, root="memory")
    columns = [ColumnMeta("ts", "timestamp"), ColumnMeta("event_type", "string", tag=True), ColumnMeta("value", "double"), ColumnMeta("user_id", "bigint")]
    table = make_table("events", columns, "ts", options={"update_mode": "OVERWRITE" if overwrite else "APPEND", "enable_ttl": "false"}, engine="Memory")
    engine.create(table)
    engine.insert("events", engine.spark.read.parquet(os.path.join(sf_dir, "events.parquet")).select("ts", "event_type", "value", "user_id"))
    return engine


def ms(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def prom(text: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = events_engine(spark, sf_dir)
        out = promql.Evaluator(engine).evaluate(promql.parse(text), START, END, STEP, lookback_ms=RANGE)
        return out.drop("tsid").withColumn("value", F.round("value", 6))

    return run


def buckets(period: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, "events")
        b = timeseries.millis(timeseries.time_bucket(F.col("ts"), period)).alias("bucket")
        return df.groupBy(b, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value") + NUDGE, 4).alias("mean"))

    return run


_AGG = "count(*) as n, round(sum(value), 2) as total, round(avg(value) + 0.0000001, 4) as mean from events group by all"
BUCKETS = {
    "ts_bucket_minute": ("PT1M", f"select (epoch_us(ts) // 1000) // 60000 * 60000 as bucket, event_type, {_AGG}"),
    "ts_bucket_hour": ("PT1H", f"select (epoch_us(ts) // 1000) // 3600000 * 3600000 as bucket, event_type, {_AGG}"),
    "ts_bucket_30s": ("PT30S", f"select (epoch_us(ts) // 1000) // 30000 * 30000 as bucket, event_type, {_AGG}"),
    "ts_bucket_day_p8": ("P1D", f"select epoch_ms(date_trunc('day', ts + interval 8 hour)) - 28800000 as bucket, event_type, {_AGG}"),
    "ts_bucket_month_p8": ("P1M", f"select epoch_ms(date_trunc('month', ts + interval 8 hour)) - 28800000 as bucket, event_type, {_AGG}"),
    "ts_bucket_year_p8": ("P1Y", f"select epoch_ms(date_trunc('year', ts + interval 8 hour)) - 28800000 as bucket, event_type, {_AGG}"),
    "ts_bucket_week_p8": ("P1W", f"select ((epoch_us(ts) // 1000) - (isodow(ts + interval 8 hour) - 1) * 604800000) // 604800000 * 604800000 as bucket, event_type, {_AGG}"),
}


def date_bin_15m(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    return df.groupBy(timeseries.millis(timeseries.date_bin(900_000, F.col("ts"))).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("top"))


def _written(spark, sf_dir) -> DataFrame:
    """Events as writes to a table with the key (event_type, hour): many writes for each key."""
    hour = timeseries.time_bucket(F.col("ts"), "PT1H")
    return read(spark, sf_dir, "events").select("event_type", ms("ts").alias("t"), F.unix_millis(hour).alias("hour"), "value", "user_id", F.lit(0).cast("long").alias("__batch"), F.col("event_id").alias("__row"))


def overwrite_dedup_latest(spark, sf_dir):
    return last_write(_written(spark, sf_dir).drop("t"), ["event_type", "hour"])


def overwrite_filter_after_dedup(spark, sf_dir):
    """A filter on a value applies to the last writes; one on the key reaches the scan."""
    return last_write(_written(spark, sf_dir).drop("t"), ["event_type", "hour"]).where((F.col("value") > 20) & (F.col("event_type") == "click"))


def append_scan_filter(spark, sf_dir):
    engine = events_engine(spark, sf_dir)
    return engine.sql("select user_id, value, event_type from events where value > 20 and event_type = 'click' and ts >= 1704844800000 and ts < 1705276800000")


def engine_sql_bucket(spark, sf_dir):
    engine = events_engine(spark, sf_dir)
    df = engine.sql("select time_bucket(ts, 'PT1H') as b, event_type, count(*) as n, sum(value) as s, avg(value) as m from events group by time_bucket(ts, 'PT1H'), event_type order by b, event_type")
    return df.select(F.unix_millis("b").alias("bucket"), "event_type", "n", F.round("s", 2).alias("total"), F.round(F.col("m") + NUDGE, 4).alias("mean"))


def engine_sql_integer_division(spark, sf_dir):
    return events_engine(spark, sf_dir).sql("select user_id / 7 as d, count(*) as n from events where event_type ~ '^(cl|vi)' group by user_id / 7")


def series_ids(spark, sf_dir):
    df = events_engine(spark, sf_dir).scan("events")
    return df.groupBy("tsid", "event_type").agg(F.count("*").alias("n"))


def key_partition_prune(spark, sf_dir):
    from .functions import hashing

    df = read(spark, sf_dir, "events").select("event_type", "user_id", "value")
    parted = hashing.with_partition(df, [("string", "event_type")], 4)
    want = sorted({hashing.key_partition([("string", v)], 4) for v in ("click", "view")})
    return parted.where(F.col("__part").isin(want) & F.col("event_type").isin("click", "view")).select("event_type", "user_id", "value")


def thetasketch(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(timeseries.thetasketch_distinct("user_id").alias("users"))


def sketch_merge(spark, sf_dir):
    """Distinct users by day as mergeable states, merged over all days."""
    day = F.date_trunc("day", F.col("ts"))
    states = read(spark, sf_dir, "events").groupBy("event_type", day.alias("day")).agg(timeseries.distinct_state("user_id").alias("state"))
    return states.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("state")).alias("users"))


def regex_match(spark, sf_dir):
    return read(spark, sf_dir, "events").where(timeseries.regex_match("event_type", "i[ec]")).groupBy("event_type").agg(F.count("*").alias("n"))


def label_not_match(spark, sf_dir):
    return read(spark, sf_dir, "events").where(timeseries.label_match("event_type", "!~", "cl.*|view")).groupBy("event_type").agg(F.count("*").alias("n"))


def opentsdb_query(aggregator: str) -> Callable:
    def run(spark, sf_dir):
        df, tags = opentsdb.sub_query(events_engine(spark, sf_dir), {"metric": "events", "aggregator": aggregator, "filters": [{"type": "literal_or", "tagk": "event_type", "filter": "click|view", "groupBy": True}]}, START, START + 5 * STEP - 1)
        return df.select(*tags, "ts", F.round("value", 6).alias("value"))

    return run


def opentsdb_series(spark, sf_dir):
    """The points of a response, a row each."""
    engine = events_engine(spark, sf_dir)
    df = opentsdb.query(engine, {"start": START, "end": START + STEP, "queries": [{"metric": "events", "aggregator": "none", "tags": {}}]})[0]
    return df.select(F.col("tags")["event_type"].alias("event_type"), F.inline("dps")).select("event_type", "ts", F.round("value", 6).alias("value"))


def hours_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """A table in memory of sums by hour, with three series for each event type."""
    engine = Engine(spark, root="memory")
    columns = [ColumnMeta("ts", "timestamp"), ColumnMeta("event_type", "string", tag=True), ColumnMeta("grp", "string", tag=True), ColumnMeta("value", "double")]
    engine.create(make_table("hours", columns, "ts", options={"update_mode": "APPEND", "enable_ttl": "false"}, engine="Memory"))
    rows = engine.spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    by = [F.expr("unix_millis(cast(ts as timestamp)) div 3600000 * 3600000").alias("ts"), "event_type", (F.col("user_id") % 3).cast("string").alias("grp")]
    engine.insert("hours", rows.groupBy(*by).agg(F.sum("value").alias("value")))
    return engine


_HOURS = "h as (select event_type, (user_id % 3)::varchar as grp, (epoch_us(ts) // 1000) // 3600000 * 3600000 as t, sum(value) as v from events group by 1, 2, 3)"


def opentsdb_hours(aggregator: str, by_type: bool) -> Callable:
    def run(spark, sf_dir):
        filters = [{"type": "not_literal_or", "tagk": "event_type", "filter": "click|error", "groupBy": by_type}]
        df, tags = opentsdb.sub_query(hours_engine(spark, sf_dir), {"metric": "hours", "aggregator": aggregator, "filters": filters}, START, START + 5 * STEP - 1)
        return df.select(*tags, "ts", F.round("value", 6).alias("value"))

    return run


def _opentsdb_hours_sql(aggregate: str, by_type: bool) -> str:
    return f"with {_HOURS} select {'event_type, ' if by_type else ''}t as ts, round({aggregate}, 6) as value from h where event_type not in ('click', 'error') and t between {START} and {START + 5 * STEP - 1} group by {'event_type, ' if by_type else ''}t"


def prom_hours(text: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = promql.Evaluator(hours_engine(spark, sf_dir)).evaluate(promql.parse(text), START, END, STEP, lookback_ms=RANGE)
        return out.drop("tsid").withColumn("value", F.round(F.col("value") + NUDGE, 4))

    return run


def _prom_hours_sql(function: str, aggregate: str) -> str:
    """The values of each of the three series of a type, not rounded, then the aggregate over them."""
    each = PROM_ORACLE[f"prom_{function}"].replace("s as (select event_type, (epoch_us(ts) // 1000) as t, value as v from events)", f"{_HOURS}, s as (select event_type || '/' || grp as event_type, t, v from h)")
    each = each.replace("as ts, round(", "as ts, (").replace(", 6) as value", ") as value")
    return f"select split_part(event_type, '/', 1) as event_type, ts, round({aggregate} + 0.0000001, 4) as value from ({each}) group by 1, 2"


def influx(text: str) -> Callable:
    def run(spark, sf_dir):
        df = influxql.query(events_engine(spark, sf_dir), text)
        return df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes if c != "tsid"])

    return run


#: All events in five-minute buckets, which leaves gaps on the whole table.
_BUCKET, _FIRST, _LAST = 300_000, 1_704_067_200_000, 1_706_745_600_000
_INFLUX_FROM = f"from events where time >= {_FIRST}ms and time < {_LAST}ms group by event_type, time(5m)"
_BUCKETED = f"b as (select event_type, (epoch_us(ts) // 1000) // {_BUCKET} * {_BUCKET} as time, count(value) as count, round(avg(value), 6) as mean from events where (epoch_us(ts) // 1000) >= {_FIRST} and (epoch_us(ts) // 1000) < {_LAST} group by 1, 2), grid as (select event_type, unnest(generate_series(min(time), {_LAST - _BUCKET}, {_BUCKET})) as time from b group by event_type)"


def default_fill(spark, sf_dir):
    """Rows of a table whose defaults refer to columns before them."""
    engine = Engine(spark, root="memory")
    engine.sql("CREATE TABLE d (ts timestamp NOT NULL TIMESTAMP KEY, event_id int64 TAG, user_id int64, c3 int64 DEFAULT user_id + 1, c4 int64 DEFAULT c3 + 1, c5 int64 DEFAULT c3 + 10) ENGINE=Memory")
    engine.insert("d", engine.spark.read.parquet(os.path.join(sf_dir, "events.parquet")).select("ts", "event_id", "user_id"))
    return engine.sql("SELECT event_id, user_id, c3, c4, c5 FROM d")


def stored_engine(spark: SparkSession, now_ms: int | None = None) -> Engine:
    """An engine over a new folder that all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:  # a folder of this machine's only if the session is local
        shared = tempfile.mkdtemp(prefix="tidemark-") if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master else spark.conf.get("spark.sql.warehouse.dir")
    return Engine(spark, root=f"{shared}/tidemark-{uuid.uuid4().hex}", now_ms=now_ms)


def stored_events(spark, sf_dir, options: str, partitions: str = "", now_ms: int | None = None) -> Engine:
    """Events in Parquet folders: series by event type and user."""
    engine = stored_engine(spark, now_ms)
    engine.sql(f"CREATE TABLE events (ts timestamp NOT NULL TIMESTAMP KEY, event_type string TAG, user_id int64 TAG, event_id int64, value double) {partitions} ENGINE=Analytic WITH ({options})")
    engine.insert("events", engine.spark.read.parquet(os.path.join(sf_dir, "events.parquet")).select("ts", "event_type", "user_id", "event_id", "value"))
    return engine


_APPEND, _OVERWRITE = "update_mode='APPEND', enable_ttl='false', segment_duration='1d'", "update_mode='OVERWRITE', enable_ttl='false', segment_duration='1d'"


def stored_pruned(spark, sf_dir):
    """A scan that reads the partitions of two types and the segments of five days."""
    engine = stored_events(spark, sf_dir, _APPEND, "PARTITION BY KEY(event_type) PARTITIONS 4")
    return engine.sql(f"SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view') AND ts >= {START} AND ts < {START + 5 * STEP}")


def rewritten(spark, sf_dir) -> Engine:
    """Every third event written once more, with another value."""
    engine = stored_events(spark, sf_dir, _OVERWRITE)
    again = engine.spark.read.parquet(os.path.join(sf_dir, "events.parquet")).where("event_id % 3 = 0")
    engine.insert("events", again.select("ts", "event_type", "user_id", "event_id", (F.col("value") + 1).alias("value")))
    return engine


def stored_overwrite(spark, sf_dir):
    return rewritten(spark, sf_dir).sql("SELECT event_id, event_type, value FROM events WHERE value > 20")


def stored_compacted(spark, sf_dir):
    engine = rewritten(spark, sf_dir)
    engine.storage("events").compact()
    return engine.storage("events").files().select("event_id", "event_type", "value")


def stored_expired(spark, sf_dir):
    """What a time to live of a week leaves on the way in."""
    return stored_events(spark, sf_dir, "update_mode='APPEND', ttl='7d'", now_ms=END).sql("SELECT event_id, value FROM events")


def stored_segments(spark, sf_dir):
    """Rows by segment folder."""
    files = stored_events(spark, sf_dir, "update_mode='APPEND', enable_ttl='false', segment_duration='2h'").storage("events").files()
    return files.groupBy(F.col("__seg").alias("segment")).agg(F.count("*").alias("n"))


def sub_tables(spark, sf_dir):
    """Rows by partition, each read by its own name."""
    engine = stored_events(spark, sf_dir, _APPEND, "PARTITION BY KEY(event_type) PARTITIONS 4")
    parts = [engine.sql(f"SELECT event_type, count(*) AS n FROM __events_{k} GROUP BY event_type") for k in range(4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def replayed_batch(spark, sf_dir):
    """A micro-batch that arrives twice is in an append table once."""
    engine = stored_engine(spark, _FIRST)  # before any of them expires
    rows = engine.spark.read.parquet(os.path.join(sf_dir, "events.parquet")).select("ts", "event_type", "value")
    for _ in range(2):
        engine.ingest("events", rows, ["event_type"], "ts", batch=7)
    return engine.storage("events").files().groupBy("event_type").agg(F.count("*").alias("n"))


def widened(spark, sf_dir):
    """Rows with a new column widen the table; earlier rows have null there."""
    engine = stored_engine(spark, _FIRST)
    rows = engine.spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    engine.ingest("events", rows.where("event_id % 2 = 0").select("ts", "event_type", "value"), ["event_type"], "ts")
    engine.ingest("events", rows.where("event_id % 2 = 1").select("ts", "event_type", "value", "user_id"), ["event_type"], "ts")
    return engine.storage("events").files().groupBy("event_type").agg(F.count("*").alias("n"), F.count("user_id").alias("users"))


def point_get(spark, sf_dir):
    """The row of one full key."""
    engine = rewritten(spark, sf_dir)
    r = read(spark, sf_dir, "events").orderBy("event_id").select("event_type", "user_id", ms("ts").alias("t")).first()
    return engine.storage("events").get({"ts": r.t, "event_type": r.event_type, "user_id": r.user_id}, ["event_id", "event_type", "value"])


def system_tables(spark, sf_dir):
    return events_engine(spark, sf_dir).tables_frame().select("table_name", "engine")


def ordered_nulls(spark, sf_dir):
    engine = events_engine(spark, sf_dir)
    return engine.sql("select event_type, n, row_number() over (order by n desc, event_type) as place_desc, row_number() over (order by n, event_type) as place from (select event_type, case when event_type in ('click', 'view') then null else count(*) end as n from events group by event_type) x")


def arrow_functions(spark, sf_dir):
    return events_engine(spark, sf_dir).sql("select user_id, arrow_typeof(user_id) as a, arrow_typeof(value) as b, arrow_typeof(event_type) as c, arrow_typeof(ts) as d, arrow_cast(value, 'Int64') as v, arrow_cast(user_id, 'Utf8') as s, array_ndims(make_array(make_array(user_id))) as n, value ilike '%1%' as one, (value > 20) is not true as small from events")


def sort_series(spark, sf_dir):
    return events_engine(spark, sf_dir).scan("events").orderBy(F.asc_nulls_first("tsid"), F.asc_nulls_first("ts")).select("event_type", ms("ts").alias("t"), "value")


def scalar_twins(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return df.select("o_orderkey", scalars.gcd(a, b).alias("g"), scalars.lcm(a % 100 + 1, b % 100 + 1).alias("l"), scalars.iszero(a % 2).alias("even"), scalars.to_hex(a).alias("h"), scalars.trunc(F.col("o_totalprice"), 1).alias("t"))


def segment_top(spark, sf_dir):
    """max(value) by minute for eight series in twelve hours: the benchmark's query class."""
    df = read(spark, sf_dir, "events")
    t = ms("ts")
    near = df.where((t >= START) & (t < START + 12 * 3_600_000) & F.col("user_id").between(1, 8))
    return near.groupBy(timeseries.millis(timeseries.time_bucket("ts", "PT1M")).alias("minute"), "user_id").agg(F.max("value").alias("top"))


def sessionized(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    df = read(spark, sf_dir, "events").select("user_id", "event_id", ms("ts").alias("t"))
    new = F.coalesce((F.col("t") - F.lag("t").over(w) > 3_600_000).cast("int"), F.lit(1))
    return df.withColumn("new", new).groupBy("user_id").agg(F.sum("new").cast("long").alias("sessions"))


def described(statement: str) -> Callable:
    """A statement about the events table, over a catalog in memory."""

    def run(spark, sf_dir):
        return events_engine(spark, sf_dir).sql(statement)

    return run


def inserted(spark, sf_dir):
    """INSERT with defaults that refer to other columns, then a query."""
    engine = Engine(spark, root="memory")
    engine.sql("CREATE TABLE d (t timestamp NOT NULL TIMESTAMP KEY, host string TAG, c1 uint32, c2 string DEFAULT 'x', c3 uint32 DEFAULT c1 + 1, c4 uint32 DEFAULT c3 * 2) ENGINE=Memory")
    engine.sql("INSERT INTO d (t, host, c1) VALUES (1, 'a', 10), (2, 'b', 20)")
    engine.sql("INSERT INTO d (t, host, c1, c3) VALUES (3, 'a', 30, 5)")
    engine.sql("ALTER TABLE d ADD COLUMN extra double")
    return engine.sql("SELECT host, c1, c2, c3, c4, extra FROM d WHERE t BETWEEN 1 AND 3")


def line_protocol(spark, sf_dir):
    """Events written as line protocol and read back."""
    from .sources.protocols import parse_lines

    df = read(spark, sf_dir, "events")
    lines = df.select(F.concat(F.lit("events,type="), "event_type", F.lit(" value="), F.col("value").cast("string"), F.lit(",user="), F.col("user_id").cast("string"), F.lit("i "), ms("ts").cast("string")).alias("value"))
    got = parse_lines(lines)
    return got.groupBy(F.col("tags")["type"].alias("event_type")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("fields")["value"].cast("double")), 2).alias("total"), F.max("ms").alias("last"))


def remote_read(spark, sf_dir):
    engine = events_engine(spark, sf_dir)
    got = promql.remote_read(engine, "events", [("event_type", "!=", "view")], START, START + STEP)
    return got.select(F.col("labels")["event_type"].alias("event_type"), F.inline("samples")).select("event_type", "ts", F.round("value", 6).alias("value"))


def tumbling_window(spark, sf_dir):
    """Windows over a stream of the events, a micro-batch at a time."""
    from .streaming.ingest import tumbling

    s = engine_session(spark)
    schema = s.read.parquet(os.path.join(sf_dir, "events.parquet")).schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"windows_{uuid.uuid4().hex}"
    counts = tumbling(stream, "ts", "6 hours", ["event_type"], "31 days", n=F.count("*"))
    counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return s.table(name).select(F.unix_millis("window.start").alias("start"), "event_type", "n")


def sampled_segment(spark, sf_dir):
    from .sources.storage import sample_segment_ms

    df = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return df.sparkSession.createDataFrame([(sample_segment_ms(df, "ts", ["event_type"]),)], "segment_ms long")


def sampled_key(spark, sf_dir):
    from .sources.storage import sample_primary_key

    engine = events_engine(spark, sf_dir)
    key = sample_primary_key(engine.scan("events"), engine.meta("events"))
    return engine.spark.createDataFrame([(i, k) for i, k in enumerate(key)], "place int, name string")


def unique_label_ids(spark, sf_dir):
    from .functions.hashing import with_unique_id

    df = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return with_unique_id(df, ["event_type"])


_COLUMNS = "(values ('tsid', 'uint64', true, false, false, false), ('ts', 'timestamp', true, false, false, false), ('event_type', 'string', false, true, true, false), ('value', 'double', false, true, false, false), ('user_id', 'bigint', false, true, false, false)) v(name, type, is_primary, is_nullable, is_tag, is_dictionary)"

# Ids of the series and of the labels of each event type, and the statement that SHOW CREATE gives.
_TSIDS = "(values ('click', 2606309108263835678::decimal(20, 0)), ('error', 8301934417804265169), ('purchase', 6954070777726114427), ('signup', 13723314681852883564), ('view', 7377786435452759649)) v(event_type, tsid)"
_LABEL_IDS = "(values ('click', 13769963711814939450::decimal(20, 0)), ('error', 4052093700403484909), ('purchase', 18320838279070871286), ('signup', 12677639013017360120), ('view', 7621984900216545533)) v(event_type, tsid)"
_SHOWN = (
    "CREATE TABLE `events` (`tsid` uint64 NOT NULL, `ts` timestamp NOT NULL, `event_type` string TAG, `value` double, `user_id` bigint, PRIMARY KEY(tsid,ts), TIMESTAMP KEY(ts)) ENGINE=Memory "
    "WITH(arena_block_size='2097152', compaction_strategy='default', compression='ZSTD', enable_ttl='false', memtable_type='skiplist', num_rows_per_row_group='8192', segment_duration='', "
    "storage_format='AUTO', ttl='7d', update_mode='APPEND', write_buffer_size='33554432')"
).replace("'", "''")

FRAMES: dict[str, tuple[Callable, str | None]] = {
    **{k: (buckets(p), o) for k, (p, o) in BUCKETS.items()},
    "date_bin_15m": (date_bin_15m, "select (epoch_us(ts) // 1000) // 900000 * 900000 as bucket, count(*) as n, round(max(value), 4) as top from events group by 1"),
    "overwrite_dedup_latest": (
        overwrite_dedup_latest,
        "select event_type, hour, value, user_id from (select *, (epoch_us(ts) // 1000) // 3600000 * 3600000 as hour, row_number() over (partition by event_type, (epoch_us(ts) // 1000) // 3600000 order by event_id desc) as k from events) where k = 1",
    ),
    "overwrite_filter_after_dedup": (
        overwrite_filter_after_dedup,
        "select event_type, hour, value, user_id from (select *, (epoch_us(ts) // 1000) // 3600000 * 3600000 as hour, row_number() over (partition by event_type, (epoch_us(ts) // 1000) // 3600000 order by event_id desc) as k from events) where k = 1 and value > 20 and event_type = 'click'",
    ),
    "append_scan_filter": (append_scan_filter, "select user_id, value, event_type from events where value > 20 and event_type = 'click' and (epoch_us(ts) // 1000) >= 1704844800000 and (epoch_us(ts) // 1000) < 1705276800000"),
    "engine_sql_bucket": (engine_sql_bucket, BUCKETS["ts_bucket_hour"][1]),
    "engine_sql_integer_division": (engine_sql_integer_division, "select user_id // 7 as d, count(*) as n from events where regexp_matches(event_type, '^(cl|vi)') group by 1"),
    "tsid_generation": (series_ids, f"select event_type, count(*) as n, tsid from events join {_TSIDS} using (event_type) group by event_type, tsid"),
    "key_partition_prune": (key_partition_prune, "select event_type, user_id, value from events where event_type in ('click', 'view')"),
    "thetasketch_distinct": (thetasketch, None),
    "thetasketch_merge": (sketch_merge, None),
    "regex_match": (regex_match, "select event_type, count(*) as n from events where regexp_matches(event_type, 'i[ec]') group by 1"),
    "label_regex_notmatch": (label_not_match, "select event_type, count(*) as n from events where not regexp_full_match(event_type, 'cl.*|view') group by 1"),
    "prom_instant": (prom("events"), PROM_ORACLE["prom_instant"]),
    **{f"prom_{f}": (prom(f"{f}(events[2d])"), PROM_ORACLE[f"prom_{f}"]) for f in promql.FUNCTIONS},
    "prom_sum_by": (prom("sum by (event_type) (delta(events[2d]))"), PROM_ORACLE["prom_delta"]),
    **{f"prom_{a}_by_two_tags": (prom_hours(f"{a} by (event_type) ({f}(hours[2d]))"), _prom_hours_sql(f, f"{a}(value)")) for a, f in (("sum", "delta"), ("avg", "rate"), ("min", "increase"), ("max", "idelta"))},
    "prom_count_by_two_tags": (prom_hours("count by (event_type) (hours)"), _prom_hours_sql("instant", "count(value)::double")),
    "prom_max_without": (prom("max without (event_type) (rate(events[2d]))"), f"select ts, max(value) as value from ({PROM_ORACLE['prom_rate']}) group by ts"),
    "prom_offset_matcher": (
        prom('idelta(events{event_type=~"cl.*|view"}[2d] offset 1d)'),
        PROM_ORACLE["prom_idelta"].replace("(epoch_us(ts) // 1000) as t", "(epoch_us(ts) // 1000) + 86400000 as t").replace("from events)", "from events where event_type in ('click', 'view'))"),
    ),
    "opentsdb_sum": (opentsdb_query("sum"), f"select event_type, (epoch_us(ts) // 1000) as ts, round(sum(value), 6) as value from events where event_type in ('click', 'view') and (epoch_us(ts) // 1000) between {START} and {START + 5 * STEP - 1} group by all"),
    "opentsdb_none": (opentsdb_query("none"), f"select event_type, (epoch_us(ts) // 1000) as ts, round(value, 6) as value from events where event_type in ('click', 'view') and (epoch_us(ts) // 1000) between {START} and {START + 5 * STEP - 1}"),
    "opentsdb_response": (opentsdb_series, f"select event_type, (epoch_us(ts) // 1000) as ts, round(value, 6) as value from events where (epoch_us(ts) // 1000) between {START} and {START + STEP}"),
    **{f"opentsdb_{a}_by_tag": (opentsdb_hours(a, True), _opentsdb_hours_sql(q, True)) for a, q in (("sum", "sum(v)"), ("avg", "avg(v)"), ("min", "min(v)"), ("max", "max(v)"), ("count", "count(v)::double"), ("dev", "stddev_samp(v)"))},
    "opentsdb_sum_no_tags": (opentsdb_hours("sum", False), _opentsdb_hours_sql("sum(v)", False)),
    "stored_pruned": (stored_pruned, f"select event_id, event_type, value from events where event_type in ('click', 'view') and epoch_us(ts) // 1000 >= {START} and epoch_us(ts) // 1000 < {START + 5 * STEP}"),
    "stored_overwrite": (stored_overwrite, "select event_id, event_type, v as value from (select *, case when event_id % 3 = 0 then value + 1 else value end as v from events) where v > 20"),
    "stored_compacted": (stored_compacted, "select event_id, event_type, case when event_id % 3 = 0 then value + 1 else value end as value from events"),
    "stored_expired": (stored_expired, f"select event_id, value from events where epoch_us(ts) // 1000 >= {END} - 604800000"),
    "stored_sub_tables": (sub_tables, "select event_type, count(*) as n from events group by 1"),
    "stored_replayed_batch": (replayed_batch, "select event_type, count(*) as n from events group by 1"),
    "stored_widened": (widened, "select event_type, count(*) as n, count(*) filter (where event_id % 2 = 1) as users from events group by 1"),
    "s11_system_tables": (system_tables, "select 'events' as table_name, 'Memory' as engine"),
    "influx_fill_linear": (
        influx(f"select mean(value) {_INFLUX_FROM} fill(linear)"),
        f"""with {_BUCKETED}, f as (select g.time, g.event_type, b.mean as m, last_value(case when b.mean is not null then g.time end ignore nulls) over p as t0, last_value(b.mean ignore nulls) over p as v0, first_value(case when b.mean is not null then g.time end ignore nulls) over n as t1, first_value(b.mean ignore nulls) over n as v1
        from grid g left join (select event_type, (epoch_us(ts) // 1000) // {_BUCKET} * {_BUCKET} as time, avg(value) as mean from events group by 1, 2) b on g.time = b.time and g.event_type = b.event_type
        window p as (partition by g.event_type order by g.time rows unbounded preceding), n as (partition by g.event_type order by g.time rows between current row and unbounded following))
        select time, event_type, round(coalesce(m, v0 + (v1 - v0) * (time - t0) / (t1 - t0)), 6) as mean from f""",
    ),
    "influx_count_fill_null": (influx(f"select count(value) {_INFLUX_FROM}"), f"with {_BUCKETED} select g.time, g.event_type, b.count from grid g left join b on g.time = b.time and g.event_type = b.event_type"),
    "influx_fill_const": (influx(f"select mean(value) {_INFLUX_FROM} fill(666)"), f"with {_BUCKETED} select g.time, g.event_type, coalesce(b.mean, 666) as mean from grid g left join b on g.time = b.time and g.event_type = b.event_type"),
    "influx_fill_none": (influx(f"select count(value) {_INFLUX_FROM} fill(none)"), f"with {_BUCKETED} select time, event_type, count from b"),
    "influx_fill_previous": (
        influx(f"select count(value) {_INFLUX_FROM} fill(previous)"),
        f"with {_BUCKETED} select g.time, g.event_type, last_value(b.count ignore nulls) over (partition by g.event_type order by g.time rows unbounded preceding) as count from grid g left join b on g.time = b.time and g.event_type = b.event_type",
    ),
    "influx_select_where": (
        influx(f"select value, event_type from events where event_type =~ /^(click|view)$/ and time < {START}ms and value > 40"),
        f"select (epoch_us(ts) // 1000) as time, round(value, 6) as value, event_type from events where event_type in ('click', 'view') and (epoch_us(ts) // 1000) < {START} and value > 40",
    ),
    "influx_group_by_tag": (influx("select count(value), max(value), min(value) from events group by event_type"), "select 0::bigint as time, event_type, count(value) as count, round(max(value), 6) as max, round(min(value), 6) as min from events group by event_type"),
    "u5_describe": (described("DESCRIBE TABLE events"), f"select * from {_COLUMNS}"),
    "u7_show_databases": (described("SHOW DATABASES"), "select 'public' as Schemas"),
    "u6_show_tables": (described("SHOW TABLES LIKE 'ev%'"), "select 'events' as Tables"),
    "u9_exists": (described("EXISTS TABLE events"), "select 1::int as result"),
    "u8_show_create": (described("SHOW CREATE TABLE events"), f"select 'events' as \"Table\", '{_SHOWN}' as \"Create Table\""),
    "u10_explain": (described("EXPLAIN SELECT count(*) FROM events WHERE ts > 1704412800000"), None),
    "k1_insert_defaults": (inserted, "select * from (values ('a', 10::bigint, 'x', 11::bigint, 22::bigint, null::double), ('b', 20, 'x', 21, 42, null), ('a', 30, 'x', 5, 10, null)) v(host, c1, c2, c3, c4, extra)"),
    "k5_line_protocol": (line_protocol, "select event_type, count(*) as n, round(sum(value), 2) as total, max(epoch_us(ts) // 1000) as last from events group by 1"),
    "p13_remote_read": (remote_read, f"select event_type, epoch_us(ts) // 1000 as ts, round(value, 6) as value from events where event_type <> 'view' and epoch_us(ts) // 1000 between {START} and {START + STEP}"),
    "p12_unique_id": (unique_label_ids, f"select event_type, count(*) as n, tsid from events join {_LABEL_IDS} using (event_type) group by event_type, tsid"),
    "k10_segments": (stored_segments, "select epoch_us(ts) // 1000 // 7200000 as segment, count(*) as n from events group by 1"),
    "r5_tumbling_window": (tumbling_window, "select epoch_us(ts) // 1000 // 21600000 * 21600000 as start, event_type, count(*) as n from events group by 1, 2"),
    "d8_segment_sampler": (sampled_segment, "with g as (select (epoch_us(ts) // 1000) - lag(epoch_us(ts) // 1000) over (partition by event_type order by ts) as gap from events), s as (select quantile_disc(gap, 0.9) * 100 as span from g where gap > 0) select min(ms)::bigint as segment_ms from (select unnest([2, 24, 168, 720, 4320, 8640, 43200, 86400])::bigint * 3600000 as ms), s where ms > span"),
    "d9_key_sampler": (sampled_key, "select * from (values (0::int, 'event_type'), (1, 'user_id'), (2, 'tsid'), (3, 'ts')) v(place, name)"),
    "default_fill": (default_fill, "select event_id, user_id, user_id + 1 as c3, user_id + 2 as c4, user_id + 11 as c5 from events"),
    "point_get": (point_get, "select event_id, event_type, case when event_id % 3 = 0 then value + 1 else value end as value from events where event_id = (select min(event_id) from events)"),
    "o1_order_nulls": (ordered_nulls, "select event_type, n, row_number() over (order by n desc nulls first, event_type)::int as place_desc, row_number() over (order by n nulls last, event_type)::int as place from (select event_type, case when event_type in ('click', 'view') then null else count(*) end as n from events group by 1)"),
    "x_arrow_functions": (arrow_functions, "select user_id, 'Int64' as a, 'Float64' as b, 'Utf8' as c, 'Timestamp(Millisecond, None)' as d, trunc(value)::bigint as v, user_id::varchar as s, 2::int as n, value::varchar ilike '%1%' as one, (value > 20) is not true as small from events"),
    "a9_approx_median": (lambda spark, sf_dir: events_engine(spark, sf_dir).sql("select event_type, round(approx_median(value), 6) as m from events group by event_type"), "select event_type, round(quantile_cont(value, 0.5), 6) as m from events group by 1"),
    "o3_sort_series": (sort_series, "select event_type, (epoch_us(ts) // 1000) as t, value from events"),
    "x_functions_without_twin": (scalar_twins, "select o_orderkey, gcd(o_orderkey, o_custkey) as g, lcm(o_orderkey % 100 + 1, o_custkey % 100 + 1) as l, (o_orderkey % 2 = 0) as even, printf('%x', o_orderkey) as h, trunc(o_totalprice * 10.0) / 10.0 as t from orders"),
    "bench_minute_top": (segment_top, f"select (epoch_us(ts) // 1000) // 60000 * 60000 as minute, user_id, max(value) as top from events where (epoch_us(ts) // 1000) >= {START} and (epoch_us(ts) // 1000) < {START + 12 * 3_600_000} and user_id between 1 and 8 group by 1, 2"),
    "w_sessions": (sessionized, "select user_id, cast(sum(case when t - p > 3600000 or p is null then 1 else 0 end) as bigint) as sessions from (select user_id, (epoch_us(ts) // 1000) as t, lag((epoch_us(ts) // 1000)) over (partition by user_id order by (epoch_us(ts) // 1000), event_id) as p from events) group by 1"),
}


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session(spark, sf_dir).sql(text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: _sql(v) for k, v in BOTH.items()} | {k: _sql(v[0]) for k, v in EACH.items()}
    return out | {k: f for k, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL; queries whose rows rest on a hash or a sketch have none."""
    out = dict(BOTH) | {k: v[1] for k, v in EACH.items()}
    return out | {k: o for k, (_, o) in FRAMES.items() if o is not None}
