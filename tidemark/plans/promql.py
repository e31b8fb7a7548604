"""A range-vector query layer: selectors, range functions, label aggregation.

The step grid is never joined: each sample is copied to the grid points whose window holds it
(range / step + 1 of them), and one aggregation by series and grid point gathers the windows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.timeseries import label_match
from ..schema import TSID, SchemaError, TableMeta

LOOKBACK_MS = 300_000
FUNCTIONS = ("rate", "increase", "delta", "irate", "idelta")
AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "avg": F.avg}
#: Label that names the field to read; a field called value is read without it.
FIELD_LABEL = "__field__"
NUMERIC = {"double", "float", "bigint", "int", "smallint", "tinyint", "uint64", "uint32", "uint16", "uint8"}


class PromError(ValueError):
    """An expression outside of the supported language."""


@dataclass(frozen=True)
class Selector:
    metric: str
    matchers: tuple[tuple[str, str, str], ...] = ()
    range_ms: int | None = None
    offset_ms: int = 0


@dataclass(frozen=True)
class Call:
    name: str
    arg: Selector


@dataclass(frozen=True)
class Aggregate:
    op: str
    arg: object
    labels: tuple[str, ...] = ()
    without: bool = False


@dataclass
class Grid:
    start: int
    end: int
    step: int
    points: int = field(init=False)

    def __post_init__(self) -> None:
        if self.step <= 0 or self.end < self.start:
            raise PromError("a grid needs a positive step and an end that isn't before its start")
        self.points = (self.end - self.start) // self.step + 1


# ---- text ---------------------------------------------------------------------------------

_TOKEN = re.compile(r'\s*(?:(?P<dur>[0-9]+(?:ms|[smhdwy]))|(?P<str>"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\')|(?P<id>[A-Za-z_:][A-Za-z0-9_:]*)|(?P<op>=~|!~|!=|[-=(){}\[\],+*/]))')
_UNIT = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 365 * 86_400_000}


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if m is None:
                raise PromError(f"unexpected at {at}: {text[at : at + 10]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def next(self, kind: str | None = None) -> str:
        if self.at >= len(self.tokens) or kind and self.tokens[self.at][0] != kind:
            raise PromError(f"expected {kind or 'more'} at {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def expect(self, text: str) -> None:
        if self.next() != text:
            raise PromError(f"expected {text}")

    def parse(self):
        e = self.expr()
        if self.at < len(self.tokens):
            raise PromError(f"unsupported operator: {self.peek()}")
        return e

    def labels(self) -> tuple[str, ...]:
        self.expect("(")
        out = []
        while self.peek() != ")":
            out.append(self.next("id"))
            if self.peek() == ",":
                self.next()
        self.expect(")")
        return tuple(out)

    def expr(self):
        name = self.next("id")
        if name in AGGREGATES and self.peek() in ("(", "by", "without"):
            mode, labels = None, ()
            if self.peek() in ("by", "without"):
                mode, labels = self.next(), self.labels()
            self.expect("(")
            arg = self.expr()
            self.expect(")")
            if mode is None and self.peek() in ("by", "without"):
                mode, labels = self.next(), self.labels()
            return Aggregate(name, arg, labels, mode == "without")
        if self.peek() == "(":
            if name not in FUNCTIONS:
                raise PromError(f"unsupported function: {name}")
            self.next()
            arg = self.expr()
            self.expect(")")
            if not isinstance(arg, Selector) or arg.range_ms is None:
                raise PromError(f"{name} takes a range selector")
            return Call(name, arg)
        return self.selector(name)

    def selector(self, metric: str) -> Selector:
        matchers, span, offset = [], None, 0
        if self.peek() == "{":
            self.next()
            while self.peek() != "}":
                label, op, value = self.next("id"), self.next("op"), self.next("str")
                matchers.append((label, op, re.sub(r"\\(.)", r"\1", value[1:-1]) if "\\\\" not in value else value[1:-1].replace("\\\\", "\\")))
                if self.peek() == ",":
                    self.next()
            self.expect("}")
        if self.peek() == "[":
            self.next()
            span = self.duration()
            self.expect("]")
        if self.peek() == "offset":
            self.next()
            offset = self.duration()
        return Selector(metric, tuple(matchers), span, offset)

    def duration(self) -> int:
        m = re.fullmatch(r"([0-9]+)(ms|[smhdwy])", self.next("dur"))
        return int(m[1]) * _UNIT[m[2]]


def parse(text: str):
    """The expression of a text."""
    return Parser(text).parse()


# ---- evaluation ---------------------------------------------------------------------------


def tiles(samples: DataFrame, by: list[str], grid: Grid, window_ms: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """(by..., tile, first, last, drops, n): what the samples between the ends of windows, or at one, come to.

    Ends of windows are multiples of ``width`` from the grid's start; tile 2j is the end j itself and
    2j + 1 what lies between the ends j and j + 1.  A window is a run of tiles, so samples are ordered
    and reduced within their tile alone, however many windows hold it.  ``first`` and ``last`` are
    structs of the tile's outer samples, the latter with the one before it; a drop is a value that a lower one follows.
    """
    width = math.gcd(grid.step, window_ms)
    t, v = F.col(ts).cast("long"), F.col(value).cast("double")
    j = F.floor((t - grid.start) / width)
    near = samples.where((t >= grid.start - window_ms) & (t <= grid.end) & v.isNotNull())
    near = near.select(*by, t.alias("ts"), v.alias("v"), (2 * j + F.when((t - grid.start) % width == 0, 0).otherwise(1)).cast("long").alias("tile"))
    order = Window.partitionBy(*by, "tile").orderBy("ts", "v")
    near = near.withColumn("before", F.lag(F.struct("ts", "v")).over(order))
    drop = F.when(F.col("v") < F.col("before.v"), F.col("before.v")).otherwise(0.0)
    place = F.struct("ts", "v")
    return near.groupBy(*by, "tile").agg(F.min(place).alias("first"), F.max(F.struct("ts", "v", "before")).alias("last"), F.sum(drop).alias("drops"), F.count("*").alias("n"))


def windows(samples: DataFrame, by: list[str], grid: Grid, window_ms: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """(by..., k, first, last, before, drops, n): for each grid point the samples of [t - window, t]; points without any are left out.

    Frames over the tiles of a series, of which there are as many as its time has ends, whatever its samples.
    """
    width = math.gcd(grid.step, window_ms)
    found = tiles(samples, by, grid, window_ms, ts, value)
    order = Window.partitionBy(*by).orderBy("tile")
    behind = F.lag("last").over(order)
    found = found.withColumn("across", F.when(F.col("first.v") < behind["v"], behind["v"]).otherwise(0.0))
    found = found.withColumn("before", F.coalesce(F.col("last.before"), F.struct(behind["ts"].alias("ts"), behind["v"].alias("v"))))
    ends = 2 * (grid.step // width)  # tiles from one grid point to the next
    span = 2 * (window_ms // width)
    low = F.greatest(F.lit(0), F.ceil(F.min("tile") / ends)).cast("long")
    high = F.least(F.lit(grid.points - 1), F.floor((F.max("tile") + span) / ends)).cast("long")
    points = found.groupBy(*by).agg(low.alias("low"), high.alias("high")).where("low <= high").select(*by, F.explode(F.sequence("low", "high")).alias("k"))
    points = points.withColumn("tile", F.col("k") * ends)
    frame = Window.partitionBy(*by).orderBy("tile").rangeBetween(-span, 0)
    head, tail = F.struct("first", "across"), F.struct("last", "before")
    both = found.select(*by, "tile", F.lit(None).cast("long").alias("k"), head.alias("head"), tail.alias("tail"), (F.col("drops") + F.col("across")).alias("drops"), "n")
    both = both.unionByName(points, allowMissingColumns=True)
    both = both.select(*by, "k", F.first("head", True).over(frame).alias("head"), F.last("tail", True).over(frame).alias("tail"), F.sum("drops").over(frame).alias("drops"), F.sum("n").over(frame).alias("n"))
    return both.where("k is not null and n > 0").select(*by, "k", "head.first", "tail.last", "tail.before", (F.col("drops") - F.col("head.across")).alias("drops"), "n")


def instant(samples: DataFrame, by: list[str], grid: Grid, lookback_ms: int = LOOKBACK_MS, ts: str = "ts", value: str = "value") -> DataFrame:
    """The last sample of each grid point's window; partially aggregated before the shuffle."""
    t = F.col(ts)
    low = F.greatest(F.lit(0), F.ceil((t - grid.start) / grid.step)).cast("long")
    high = F.least(F.lit(grid.points - 1), F.floor((t + lookback_ms - grid.start) / grid.step)).cast("long")
    near = samples.where((t >= grid.start - lookback_ms) & (t <= grid.end) & F.col(value).isNotNull()).withColumn("__low", low).withColumn("__high", high).where("__low <= __high")
    last = near.withColumn("k", F.explode(F.sequence("__low", "__high"))).groupBy(*by, "k").agg(F.max_by(F.col(value).cast("double"), t).alias("value"))
    return last.select(*by, (F.col("k") * grid.step + grid.start).alias("ts"), "value")


def window_value(name: str, t: Column, range_ms: int) -> Column:
    """A range function over what ``windows`` tells of a window that ends at ``t``."""
    first, last, before, n = F.col("first"), F.col("last"), F.col("before"), F.col("n") - 1
    if name in ("irate", "idelta"):
        if name == "idelta":
            got = last["v"] - before["v"]
        else:
            got = F.when(last["v"] < before["v"], last["v"]).otherwise(last["v"] - before["v"]) / ((last["ts"] - before["ts"]) / 1000.0)
        return F.when(n >= 2, got)
    counter = name in ("rate", "increase")
    diff = last["v"] - first["v"]
    if counter:  # a drop is a reset: the value before it is added
        diff = diff + F.col("drops")
    length = (last["ts"] - first["ts"]).cast("double")
    average = length / n
    head, tail = (first["ts"] - (t - range_ms)).cast("double"), (t - last["ts"]).cast("double")
    if counter:  # a counter doesn't start below zero
        head = F.when((diff > 0) & (first["v"] >= 0), F.least(head, length * first["v"] / diff)).otherwise(head)
    near = lambda gap: F.when(gap > average * 1.1, average / 2).otherwise(gap)
    got = diff * (length + near(head) + near(tail)) / length
    if name == "rate":
        got = got / (range_ms / 1000.0)
    return F.when(n >= 1, got)


def range_function(name: str, samples: DataFrame, by: list[str], grid: Grid, range_ms: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """(by..., ts, value) of a range function; grid points without a value are left out."""
    t = F.col("k") * grid.step + grid.start
    found = windows(samples, by, grid, range_ms, ts, value).where(F.col("n") >= (3 if name in ("irate", "idelta") else 2))
    return found.select(*by, t.alias("ts"), window_value(name, t, range_ms).alias("value"))


def field_of(meta: TableMeta, matchers: tuple) -> str:
    """The field that a selector reads."""
    name = next((v for k, op, v in matchers if k == FIELD_LABEL and op == "="), "value")
    if not meta.has(name) or meta.column(name).kind not in NUMERIC:
        raise SchemaError(f"no numeric field {name} in {meta.name}")
    return name


class Evaluator:
    """Expressions over the tables of an engine."""

    def __init__(self, engine) -> None:
        self.engine = engine

    def samples(self, s: Selector, start: int, end: int) -> tuple[DataFrame, list[str]]:
        """(tsid, tags..., ts, value) of a selector's rows, and the tags."""
        from ..sources.storage import TimeRange

        meta = self.engine.meta(s.metric)
        tags = [c.name for c in meta.tags]
        value = field_of(meta, s.matchers)
        start, end = start - s.offset_ms, end - s.offset_ms
        keys = {k: {v} for k, op, v in s.matchers if op == "=" and k in tags}
        df = self.engine.scan(s.metric, TimeRange(start, end + 1), keys)
        ms = F.unix_millis(F.col(f"`{meta.timestamp_key}`"))
        df = df.where((ms >= start) & (ms <= end))
        for label, op, v in s.matchers:
            if label == FIELD_LABEL:
                continue
            if label not in tags:
                continue  # filters on unknown labels are dropped
            df = df.where(label_match(F.col(f"`{label}`"), op, v))
        return df.select(TSID, *[F.col(f"`{t}`") for t in tags], (ms + s.offset_ms).alias("ts"), F.col(f"`{value}`").cast("double").alias("value")), tags

    def raw(self, s: Selector, start: int, end: int) -> DataFrame:
        """A bare selector at top level: the rows themselves, by series and time."""
        df, tags = self.samples(s, start, end)
        return df.orderBy(F.asc_nulls_first(TSID), F.asc_nulls_first("ts"))

    def evaluate(self, e, start: int, end: int, step: int, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
        """(tsid, labels..., ts, value) on the grid."""
        grid = Grid(start, end, step)
        df, _ = self._eval(e, grid, lookback_ms)
        return df.orderBy(F.asc_nulls_first(TSID), F.asc_nulls_first("ts"))

    def _eval(self, e, grid: Grid, lookback_ms: int) -> tuple[DataFrame, list[str]]:
        if isinstance(e, Selector):
            if e.range_ms is not None:
                raise PromError("a range selector needs a function")
            df, tags = self.samples(e, grid.start - lookback_ms, grid.end)
            return instant(df, [TSID, *tags], grid, lookback_ms), tags
        if isinstance(e, Call):
            df, tags = self.samples(e.arg, grid.start - e.arg.range_ms, grid.end)
            return range_function(e.name, df, [TSID, *tags], grid, e.arg.range_ms), tags
        if isinstance(e, Aggregate):
            df, tags = self._eval(e.arg, grid, lookback_ms)
            return aggregate(df, tags, e)
        raise PromError(f"unsupported expression: {e}")


def aggregate(df: DataFrame, tags: list[str], e: Aggregate) -> tuple[DataFrame, list[str]]:
    """By or without labels at each time; labels that the series lack are ignored."""
    if e.op not in AGGREGATES:
        raise PromError(f"unsupported aggregation: {e.op}")
    labels = [t for t in tags if t not in e.labels] if e.without else [t for t in e.labels if t in tags]
    got = df.groupBy(*[F.col(f"`{x}`") for x in labels], "ts").agg(AGGREGATES[e.op]("value").cast("double").alias("value"))
    return hashing.with_unique_id(got, labels, TSID).select(TSID, *[F.col(f"`{x}`") for x in labels], "ts", "value"), labels


#: Time that one row of a remote read holds, so that no row grows with a series' history.
CHUNK_MS = 86_400_000


def remote_read(engine, metric: str, matchers: list[tuple[str, str, str]], start: int, end: int) -> DataFrame:
    """Rows by series and day, in order: labels (null as empty) and the samples by time."""
    s = Selector(metric, tuple(matchers))
    df, tags = Evaluator(engine).samples(s, start, end)
    labels = F.map_from_arrays(F.array(*map(F.lit, tags)), F.array(*[F.coalesce(F.col(f"`{t}`").cast("string"), F.lit("")) for t in tags])) if tags else F.create_map().cast("map<string,string>")
    each = df.select(TSID, F.floor(F.col("ts") / CHUNK_MS).alias("__day"), labels.alias("labels"), F.struct("ts", "value").alias("s"))
    return each.groupBy(TSID, "__day").agg(F.first("labels").alias("labels"), F.array_sort(F.collect_list("s")).alias("samples")).orderBy(TSID, "__day").drop("__day")
