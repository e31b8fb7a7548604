"""Rows from line protocol, OpenTSDB puts and remote writes, as DataFrames for ``Engine.ingest``."""

from __future__ import annotations

import json
import re
import time
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SchemaError

PRECISION_MS = {"ns": 1e-6, "n": 1e-6, "us": 1e-3, "u": 1e-3, "µ": 1e-3, "ms": 1.0, "s": 1e3, "m": 6e4, "h": 3.6e6}
#: Numbers up to the first are too small for a time, up to the second seconds, up to the third milliseconds.
TIME_BOUNDS = (4294967, 4294967295, 9999999999999)


# ---- line protocol ------------------------------------------------------------------------

_SPLIT_SPACE, _SPLIT_COMMA = re.compile(r"(?<!\\) "), re.compile(r"(?<!\\),")
_UNESCAPE = re.compile(r"\\([,= \\])")


def _split(text: str, sep: str) -> list[str]:
    """Parts between separators that are neither escaped nor in double quotes."""
    out, held, quoted, k = [], "", False, 0
    while k < len(text):
        c = text[k]
        if c == "\\" and k + 1 < len(text):
            held += text[k : k + 2]
            k += 2
            continue
        if c == '"':
            quoted = not quoted
        if c == sep and not quoted:
            out.append(held)
            held = ""
        else:
            held += c
        k += 1
    return [*out, held]


def _field(text: str):
    if text.startswith('"') and text.endswith('"') and len(text) > 1:
        return text[1:-1].replace('\\"', '"').replace("\\\\", "\\")
    if text in ("t", "T", "true", "True", "TRUE"):
        return True
    if text in ("f", "F", "false", "False", "FALSE"):
        return False
    if re.fullmatch(r"[+-]?[0-9]+i", text):
        return int(text[:-1])
    if re.fullmatch(r"[0-9]+u", text):
        return ("u", int(text[:-1]))
    return float(text)


def parse_line(line: str, precision: str = "ms", now_ms: int | None = None):
    """(measurement, tags, fields, ms) of a line; None for blank lines and comments."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    parts = [p for p in _split(line, " ") if p]
    if len(parts) not in (2, 3):
        raise SchemaError(f"not a line: {line[:60]!r}")
    un = lambda s: _UNESCAPE.sub(r"\1", s)
    head = _split(parts[0], ",")
    tags = dict(sorted((un(k), un(v)) for k, v in (_split(t, "=") for t in head[1:])))
    fields = dict(sorted((un(k), _field("=".join(v))) for k, *v in (_split(f, "=") for f in _split(parts[1], ","))))
    ms = int(int(parts[2]) * PRECISION_MS[precision]) if len(parts) == 3 else now_ms if now_ms is not None else int(time.time() * 1000)
    return un(head[0]), tags, fields, ms


def read_lines(spark: SparkSession, path: str, precision: str = "ms", now_ms: int | None = None) -> DataFrame:
    """(measurement, timestamp, tags map, fields map, kinds map) of the lines in text files, parsed in parallel."""
    return parse_lines(spark.read.text(path), precision, now_ms)


def parse_lines(lines: DataFrame, precision: str = "ms", now_ms: int | None = None) -> DataFrame:
    """The same of a DataFrame with a ``value`` column, batch or streaming."""
    if precision not in PRECISION_MS:
        raise SchemaError(f"unknown precision: {precision}")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                got = parse_line(text, precision, now_ms)
                if got is None:
                    continue
                name, tags, fields, ms = got
                plain = {k: v[1] if isinstance(v, tuple) else v for k, v in fields.items()}
                kinds = {k: "uint64" if isinstance(v, tuple) else {bool: "boolean", int: "bigint", float: "double", str: "string"}[type(v)] for k, v in fields.items()}
                rows.append((name, ms, tags, {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in plain.items()}, kinds))
            yield pd.DataFrame(rows, columns=["measurement", "ms", "tags", "fields", "kinds"])

    return lines.select("value").mapInPandas(run, "measurement string, ms long, tags map<string,string>, fields map<string,string>, kinds map<string,string>")


def write_lines(engine, parsed: DataFrame, batch: int | None = None) -> int:
    """Ingest parsed lines, measurement by measurement; gives the number of measurements."""
    spark_types = {"uint64": "decimal(20,0)", "bigint": "bigint", "double": "double", "string": "string", "boolean": "boolean"}
    parsed = parsed.persist()
    try:
        shapes = parsed.select(
            "measurement", F.array_sort(F.map_keys("tags")).alias("tags"), F.array_sort(F.transform(F.map_entries("kinds"), lambda e: F.struct(e["key"], e["value"]))).alias("kinds")
        ).distinct().collect()  # as many as there are shapes of rows, not rows
        tags_of, kinds_of = defaultdict(set), defaultdict(dict)
        for r in shapes:
            tags_of[r.measurement] |= set(r.tags)
            for k in r.kinds:
                if kinds_of[r.measurement].setdefault(k[0], k[1]) != k[1]:
                    raise SchemaError(f"field {k[0]} of {r.measurement} has several types")
        for name, kinds in sorted(kinds_of.items()):
            tags = sorted(tags_of[name])
            rows = parsed.where(F.col("measurement") == name).select(
                F.timestamp_millis("ms").alias("timestamp"), *[F.col("tags")[t].alias(t) for t in tags], *[F.col("fields")[f].cast(spark_types[k]).alias(f) for f, k in sorted(kinds.items())]
            )
            engine.ingest(name, rows, tags, batch=batch)
        return len(kinds_of)
    finally:
        parsed.unpersist()


# ---- OpenTSDB put -------------------------------------------------------------------------


def normalized_time(t: int) -> int:
    """Milliseconds of a put's timestamp, which is in seconds or milliseconds."""
    low, seconds, millis = TIME_BOUNDS
    if low < t <= seconds:
        return t * 1000
    if seconds < t <= millis:
        return t
    raise SchemaError(f"timestamp out of range: {t}")


def parse_put(body: str) -> list[tuple]:
    """(metric, ms, tags, value) of a put: an object or an array of them."""
    if not body.strip():
        raise SchemaError("an empty put")
    try:
        points = json.loads(body)
    except json.JSONDecodeError as e:
        raise SchemaError(f"not JSON: {e}") from e
    out = []
    for p in points if isinstance(points, list) else [points]:
        if not p.get("metric"):
            raise SchemaError("a metric is needed")
        tags = p.get("tags") or {}
        if not tags or any(not k for k in tags):
            raise SchemaError("at least one tag is needed, and tags have names")
        out.append((p["metric"], normalized_time(int(p["timestamp"])), dict(sorted(tags.items())), float(p["value"])))
    return out


def _ingest_points(engine, points: list[tuple]) -> int:
    by_metric = defaultdict(list)
    for metric, ms, tags, value in points:
        by_metric[metric].append((ms, tags, value))
    for metric, rows in sorted(by_metric.items()):
        tags = sorted({t for _, m, _ in rows for t in m})
        df = engine.spark.createDataFrame([(ms, m, v) for ms, m, v in rows], "ms long, tags map<string,string>, value double")
        engine.ingest(metric, df.select(F.timestamp_millis("ms").alias("timestamp"), *[F.col("tags")[t].alias(t) for t in tags], "value"), tags)
    return len(points)


def put(engine, body: str) -> int:
    """Ingest an OpenTSDB put; gives the number of points."""
    return _ingest_points(engine, parse_put(body))


def remote_write(engine, request: dict) -> int:
    """Ingest a remote write, given as {"timeseries": [{"labels": {...}, "samples": [[ms, value], ...]}]}."""
    points = []
    for series in request["timeseries"]:
        labels = dict(sorted(series["labels"].items()))
        metric = labels.pop("__name__", None)
        if not metric:
            raise SchemaError("a series needs a __name__")
        points += [(metric, int(ms), labels, float(v)) for ms, v in series["samples"]]
    return _ingest_points(engine, points)
