"""InfluxQL queries over one measurement: fields or aggregates, tag and time groups, gap filling."""

from __future__ import annotations

import re
import time as clock
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TSID, SchemaError, TableMeta
from ..sources.storage import TimeRange

AGGREGATES = {
    "count": F.count, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev, "median": F.median, "spread": lambda c: F.max(c) - F.min(c), "distinct": F.collect_set,
    "mode": F.mode,
}
UNITS = {"ns": 1e-6, "u": 1e-3, "µ": 1e-3, "ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
_TOKEN = re.compile(
    r"""\s*(?:(?P<dur>[0-9]+(?:ns|ms|[uµsmhdw])(?![A-Za-z]))|(?P<num>-?[0-9]+(?:\.[0-9]+)?)|(?P<str>'(?:[^'\\]|\\.)*')|(?P<quoted>"(?:[^"\\]|\\.)*")
      |(?P<id>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>=~|!~|!=|<>|<=|>=|[-+*/%=<>(),.;]))""",
    re.VERBOSE,
)


_PATTERN = re.compile(r"\s*(?P<regex>/(?:[^/\\]|\\.)*/)")


class InfluxError(ValueError):
    """A query outside of the supported language."""


@dataclass
class Item:
    name: str | None  # None: every field and tag
    function: str | None = None
    argument: float | None = None
    alias: str | None = None


@dataclass
class Select:
    items: list[Item]
    measurement: str
    where: Column | None = None
    span: TimeRange = field(default_factory=TimeRange)
    tags: list[str] = field(default_factory=list)
    every_ms: int | None = None
    fill: str | float = "null"
    limit: int | None = None
    offset: int = 0
    descending: bool = False


class Parser:
    def __init__(self, text: str, engine) -> None:
        self.engine = engine
        self.tokens: list[tuple[str, str]] = []
        text = text.strip().rstrip(";")
        at = 0
        while at < len(text):
            after_match = self.tokens and self.tokens[-1][1] in ("=~", "!~") or self.tokens and self.tokens[-1][1].upper() == "FROM"
            m = after_match and _PATTERN.match(text, at) or _TOKEN.match(text, at)
            if m is None:
                raise InfluxError(f"unexpected at {at}: {text[at : at + 10]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup).strip()))
            at = m.end()
        self.at = 0
        self.meta: TableMeta | None = None

    def word(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.tokens[k][1].upper() if k < len(self.tokens) and self.tokens[k][0] in ("id", "op") else ""

    def accept(self, *words: str) -> bool:
        if all(self.word(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            raise InfluxError(f"expected {' '.join(words)} at {self.tokens[self.at : self.at + 2]}")

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise InfluxError("the query ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def name(self) -> str:
        kind, text = self.next()
        if kind == "quoted":
            return text[1:-1]
        if kind == "id":
            return text
        raise InfluxError(f"expected a name, found {text}")

    def parse(self):
        if self.accept("SHOW"):
            return self.show()
        self.expect("SELECT")
        items = self.items()
        self.expect("FROM")
        if self.word() == "(":
            raise InfluxError("subqueries aren't supported")
        if self.tokens[self.at][0] == "regex" or self.word() == "/":
            raise InfluxError("a measurement can't be a pattern")
        s = Select(items, self.name())
        if self.accept(","):
            raise InfluxError("one measurement at a time")
        self.meta = self.engine.meta(s.measurement)
        if self.accept("WHERE"):
            s.where, s.span = self.condition()
        if self.accept("GROUP", "BY"):
            while True:
                if self.word() == "TIME" and self.word(1) == "(":
                    self.at += 2
                    s.every_ms = self.duration()
                    self.expect(")")
                elif self.accept("*"):
                    s.tags += [c.name for c in self.meta.tags]
                else:
                    s.tags.append(self.name())
                if not self.accept(","):
                    break
        if self.accept("FILL"):
            self.expect("(")
            kind, text = self.next()
            s.fill = float(text) if kind == "num" else text.lower()
            self.expect(")")
        if self.accept("ORDER", "BY"):
            if self.name() != "time":
                raise InfluxError("only time can order")
            s.descending = self.accept("DESC")
            self.accept("ASC")
        if self.accept("LIMIT"):
            s.limit = int(self.next()[1])
        if self.accept("OFFSET"):
            s.offset = int(self.next()[1])
        if self.at < len(self.tokens):
            raise InfluxError(f"unsupported: {self.tokens[self.at][1]}")
        return s

    def items(self) -> list[Item]:
        out = []
        while True:
            if self.accept("*"):
                out.append(Item(None))
            else:
                name = self.name()
                item = Item(name)
                if self.accept("("):
                    inner = None if self.accept("*") else self.name()
                    argument = float(self.next()[1]) if self.accept(",") else None
                    self.expect(")")
                    item = Item(inner, name.lower(), argument)
                    if item.function not in (*AGGREGATES, "first", "last", "percentile"):
                        raise InfluxError(f"unsupported function: {name}")
                if self.accept("AS"):
                    item.alias = self.name()
                out.append(item)
            if not self.accept(","):
                return out

    def duration(self) -> int:
        kind, text = self.next()
        m = re.fullmatch(r"([0-9]+)(\D+)", text)
        if kind != "dur" or not m:
            raise InfluxError(f"expected a duration, found {text}")
        return int(int(m[1]) * UNITS[m[2]])

    # conditions: (column, time range)

    def condition(self):
        left, span = self.conjunction()
        while self.accept("OR"):
            right, other = self.conjunction()
            left, span = left | right, span.either(other)
        return left, span

    def conjunction(self):
        left, span = self.comparison()
        while self.accept("AND"):
            right, other = self.comparison()
            left, span = left & right, span.both(other)
        return left, span

    def comparison(self):
        if self.accept("("):
            got = self.condition()
            self.expect(")")
            return got
        name = self.name()
        op = self.next()[1]
        if name == "time":
            return self._time(op)
        if not self.meta.has(name):
            return F.lit(False), TimeRange()
        c = F.col(f"`{name}`")
        kind, text = self.next()
        if op in ("=~", "!~"):
            pattern = text[1:-1].replace("\\/", "/")
            return (c.rlike(pattern) if op == "=~" else ~c.rlike(pattern)), TimeRange()
        value = text[1:-1].replace("\\'", "'") if kind == "str" else text.lower() == "true" if text.lower() in ("true", "false") else float(text) if "." in text else int(text)
        return {"=": c == value, "!=": c != value, "<>": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op], TimeRange()

    def _time(self, op: str):
        ms = self.instant()
        c = F.unix_millis(F.col(f"`{self.meta.timestamp_key}`"))
        spans = {"=": TimeRange(ms, ms + 1), "<": TimeRange(None, ms), "<=": TimeRange(None, ms + 1), ">": TimeRange(ms + 1, None), ">=": TimeRange(ms, None)}
        if op not in spans:
            raise InfluxError(f"unsupported for time: {op}")
        return {"=": c == ms, "<": c < ms, "<=": c <= ms, ">": c > ms, ">=": c >= ms}[op], spans[op]

    def instant(self) -> int:
        if self.accept("NOW", "(", ")"):
            ms = int(clock.time() * 1000)
        else:
            kind, text = self.next()
            if kind == "str":
                from ..sql.dialect import timestamp_ms

                ms = timestamp_ms(text[1:-1])
            elif kind == "dur":
                self.at -= 1
                ms = self.duration()
            else:
                ms = int(text) // 1_000_000  # nanoseconds
        while self.word() in ("+", "-"):
            sign = -1 if self.next()[1] == "-" else 1
            ms += sign * self.duration()
        return ms

    def show(self) -> DataFrame:
        spark, engine = self.engine.spark, self.engine
        if self.accept("MEASUREMENTS"):
            return spark.createDataFrame([(n,) for n in engine.tables()], "name string")
        what = self.name().upper(), self.name().upper()
        names = [self.name()] if self.accept("FROM") else engine.tables()
        if what == ("TAG", "KEYS"):
            return spark.createDataFrame([(n, c.name) for n in names for c in engine.meta(n).tags], "measurement string, tagKey string")
        if what == ("FIELD", "KEYS"):
            return spark.createDataFrame([(n, c.name, c.kind) for n in names for c in engine.meta(n).fields], "measurement string, fieldKey string, fieldType string")
        if what == ("TAG", "VALUES"):
            self.expect("WITH")
            self.expect("KEY")
            self.expect("=")
            key = self.name()
            frames = [engine.scan(n).select(F.lit(n).alias("measurement"), F.lit(key).alias("key"), F.col(f"`{key}`").cast("string").alias("value")).distinct() for n in names if engine.meta(n).has(key)]
            out = spark.createDataFrame([], "measurement string, key string, value string")
            for f in frames:
                out = out.unionByName(f)
            return out.where("value is not null").orderBy("measurement", "value")
        raise InfluxError(f"unsupported: SHOW {' '.join(what)}")


def aggregate(item: Item, meta: TableMeta) -> Column:
    c, ts = F.col(f"`{item.name}`"), F.col(f"`{meta.timestamp_key}`")
    if item.function == "first":
        return F.min_by(c, ts)
    if item.function == "last":
        return F.max_by(c, ts)
    if item.function == "percentile":
        return F.percentile_approx(c, item.argument / 100)
    return AGGREGATES[item.function](c)


def gap_filled(df: DataFrame, keys: list[str], step: int, upper: int | None, names: list[str], fill) -> DataFrame:
    """One row for each step of each group, from its first bucket to the upper bound (else its last bucket).

    ``df`` has keys, ``time`` (ms) and the values.  The grid is made from one row for each group.
    """
    if fill == "none":
        return df
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys])
    last = F.lit((upper - 1) // step * step) if upper is not None else F.max("time")
    groups = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min("time").alias("__first"), last.alias("__last")) if upper is None else df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min("time").alias("__first")).withColumn("__last", last)
    grid = groups.select(*[F.col(f"`{k}`").alias(f"__g_{k}") for k in keys], F.explode(F.sequence(F.col("__first"), F.greatest("__first", "__last"), F.lit(step))).alias("__time"))
    on = grid["__time"] == df["time"]
    for k in keys:
        on = on & grid[f"`__g_{k}`"].eqNullSafe(df[f"`{k}`"])
    out = grid.join(df, on, "left").select(*[F.col(f"`__g_{k}`").alias(k) for k in keys], F.col("__time").alias("time"), *[F.col(f"`{n}`") for n in names])
    ordered = w.orderBy("time") if keys else Window.partitionBy(F.lit(1)).orderBy("time")
    for n in names:
        c = F.col(f"`{n}`")
        if fill == "previous":
            out = out.withColumn(n, F.last(c, True).over(ordered))
        elif fill == "linear":
            point = F.when(c.isNotNull(), F.struct(F.col("time").alias("t"), c.cast("double").alias("v")))
            before, after = F.last(point, True).over(ordered), F.first(point, True).over(ordered.rowsBetween(0, Window.unboundedFollowing))
            out = out.withColumn(n, F.coalesce(c.cast("double"), before["v"] + (after["v"] - before["v"]) * (F.col("time") - before["t"]) / (after["t"] - before["t"])))
        elif fill != "null":
            out = out.withColumn(n, F.coalesce(c, F.lit(fill).cast(dict(out.dtypes)[n])))
    return out


def query(engine, text: str) -> DataFrame:
    """The rows of a query: ``time`` in milliseconds, group tags, then the values."""
    s = Parser(text, engine).parse()
    if isinstance(s, DataFrame):
        return s
    meta = engine.meta(s.measurement)
    df = engine.scan(s.measurement, s.span)
    if s.where is not None:
        df = df.where(s.where)
    ms = F.unix_millis(F.col(f"`{meta.timestamp_key}`"))
    if any(i.function for i in s.items):
        if not all(i.function for i in s.items):
            raise InfluxError("fields and aggregates don't mix")
        items = [x for i in s.items for x in ([i] if i.name else [Item(c.name, i.function, i.argument, f"{i.function}_{c.name}") for c in meta.fields])]
        names = []
        for i in items:
            base = i.alias or i.function
            names.append(base if base not in names else f"{base}_{sum(n == base or n.startswith(base + '_') for n in names)}")
        step = s.every_ms
        bucket = (ms - F.pmod(ms, F.lit(step))) if step else F.lit(0).cast("long")
        got = df.groupBy(*[F.col(f"`{t}`") for t in s.tags], bucket.alias("time")).agg(*[aggregate(i, meta).alias(n) for i, n in zip(items, names, strict=True)])
        if step:
            got = gap_filled(got, s.tags, step, s.span.end, names, s.fill)
        out = got.select("time", *[F.col(f"`{t}`") for t in s.tags], *[F.col(f"`{n}`") for n in names])
        order = [*[F.asc_nulls_first(F.col(f"`{t}`")) for t in s.tags], F.desc("time") if s.descending else F.asc("time")]
    else:
        columns = []
        for i in s.items:
            if i.name is None:
                columns += [(c.name, c.name) for c in sorted(meta.columns, key=lambda c: c.name) if c.name != meta.timestamp_key]
            elif i.name != "time":
                columns.append((i.name, i.alias or i.name))
        for n, _ in columns:
            meta.column(n)
        out = df.select(ms.alias("time"), *[F.col(f"`{n}`").alias(a) for n, a in columns])
        order = [F.desc("time") if s.descending else F.asc("time"), *[F.asc_nulls_first(F.col(f"`{a}`")) for n, a in columns if n in [t.name for t in meta.tags]]]
    out = out.orderBy(*order)
    if s.offset:
        out = out.offset(s.offset)
    return out.limit(s.limit) if s.limit is not None else out


def respond(engine, text: str) -> dict:
    """The response: one statement, one series."""
    df = query(engine, text)
    show = re.match(r"\s*show\s+measurements", text, re.IGNORECASE)
    name = "measurements" if show else (Parser(text, engine).parse().measurement if not re.match(r"\s*show\b", text, re.IGNORECASE) else "results")
    return {"results": [{"statement_id": 0, "series": [{"name": name, "columns": df.columns, "values": [[int(v) if c == TSID else v for c, v in zip(df.columns, r, strict=True)] for r in df.toLocalIterator()]}]}]}


__all__ = ["InfluxError", "SchemaError", "gap_filled", "query", "respond"]
