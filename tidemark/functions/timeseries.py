"""Time buckets and sketches as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days, weeks, months and years begin at midnight of this zone.
ZONE = "+08:00"
DAY = 86_400_000
UNIT_MS = {"S": 1000, "M": 60_000, "H": 3_600_000}


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def time_bucket(ts: Column | str, period: str, fmt: str | None = None, tz: str | None = None, out_fmt: str | None = None, zone: str = ZONE) -> Column:
    """Start of the bucket of ``period`` (ISO 8601: PTnS, PTnM, PTnH, PnD, P1W, P1M, P1Y) that holds ``ts``.

    The last three arguments of the SQL function are accepted without effect.
    """
    ts = _column(ts)
    if m := re.fullmatch(r"PT([0-9]{1,5})([SMH])", period):
        n = int(m[1])
        if not 0 < n < 1 << 16:
            raise ValueError(f"period out of range: {period}")
        width = n * UNIT_MS[m[2]]
        return F.timestamp_millis(F.expr("bigint(0)") + _div(millis(ts), width) * width)
    local = F.from_utc_timestamp(ts.cast("timestamp"), zone)
    back = lambda c: F.to_utc_timestamp(c, zone)
    if period in ("P1D", "P1M", "P1Y"):
        return back(F.date_trunc({"D": "day", "M": "month", "Y": "year"}[period[-1]], local))
    if m := re.fullmatch(r"P([0-9]{1,5})D", period):
        n = int(m[1])
        if n < 1:
            raise ValueError(f"period out of range: {period}")
        day = F.dayofmonth(local)
        start = day - day % n
        first = F.date_trunc("month", local)
        bad = F.raise_error(F.lit(f"no day of the month begins a bucket of {period}"))
        return F.when(ts.isNull(), F.lit(None)).when(start < 1, bad.cast("timestamp")).otherwise(back((first.cast("timestamp") + F.make_dt_interval(days=start - 1)).cast("timestamp")))
    if period == "P1W":
        # kept as it is defined: as many whole weeks back as days since Monday, then floored to weeks of the epoch
        since_monday = ((F.dayofweek(local) + 5) % 7).cast("long")
        week = 7 * DAY
        return F.timestamp_millis(_div(millis(ts) - since_monday * week, week) * week)
    raise ValueError(f"unsupported period: {period}")


def week_bucket(ts: Column | str, zone: str = ZONE) -> Column:
    """Monday midnight of the week of ``ts`` in ``zone``."""
    return F.to_utc_timestamp(F.date_trunc("week", F.from_utc_timestamp(_column(ts).cast("timestamp"), zone)), zone)


def _div(a: Column, b: int) -> Column:
    """Integer division, toward zero."""
    return F.when(a.isNotNull(), (a - F.sign(a).cast("long") * (F.abs(a) % b)) / b).cast("long")


def date_bin(width_ms: int, ts: Column | str, origin_ms: int = 0) -> Column:
    """Start of the bin of ``width_ms`` milliseconds, counted from the origin, that holds ``ts``."""
    since = millis(_column(ts)) - origin_ms
    return F.timestamp_millis(since - F.pmod(since, F.lit(width_ms)) + origin_ms)


def thetasketch_distinct(x: Column | str) -> Column:
    """Approximate number of distinct values, with a relative deviation of one percent."""
    return F.approx_count_distinct(_column(x), 0.01)


def distinct_state(x: Column | str) -> Column:
    """A mergeable sketch of distinct values; ``F.hll_union_agg`` merges, ``F.hll_sketch_estimate`` reads."""
    return F.hll_sketch_agg(_column(x), 14)


def regex_match(x: Column | str, pattern: str) -> Column:
    """Whether the pattern is found anywhere; null for null."""
    return _column(x).rlike(pattern)


def label_match(x: Column | str, op: str, value: str) -> Column:
    """A label matcher: = != =~ !~, the last two over the whole value."""
    c = _column(x)
    if op == "=":
        return c == value
    if op == "!=":
        return c != value
    if op in ("=~", "!~"):
        hit = c.rlike(f"^(?:{value})$")
        return hit if op == "=~" else ~hit
    raise ValueError(f"unknown matcher: {op}")
