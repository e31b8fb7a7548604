"""OpenTSDB queries: a list of sub-queries over tables with a ``value`` field."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TSID, SchemaError
from ..sources.storage import TimeRange

FIELD = "value"
AGGREGATORS = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max, "dev": F.stddev}
FILTERS = ("literal_or", "not_literal_or")


def sub_query(engine, q: dict, start: int, end: int) -> tuple[DataFrame, list[str]]:
    """(tags..., ts, value) of one sub-query, and the tags that name its series.

    ``rate``, ``downsample`` and ``msResolution`` are accepted without effect.
    """
    meta = engine.meta(q["metric"])
    if not meta.has(FIELD):
        raise SchemaError(f"{meta.name} has no field {FIELD}")
    tags = [c.name for c in meta.tags]
    equal = q.get("tags") or {}
    filters = q.get("filters") or []
    df = engine.scan(meta.name, TimeRange(start, end + 1), {k: {v} for k, v in equal.items() if k in tags})
    ms = F.unix_millis(F.col(f"`{meta.timestamp_key}`"))
    df = df.where((ms >= start) & (ms <= end))
    group = []
    for tag, value in equal.items():
        df = df.where(F.col(f"`{tag}`") == value)
        group.append(tag)
    for f in filters:
        kind = f["type"]
        if kind not in FILTERS:
            raise SchemaError(f"unsupported filter: {kind}")
        hit = F.col(f"`{f['tagk']}`").isin(f["filter"].split("|"))
        df = df.where(hit if kind == "literal_or" else ~hit)
        if f.get("groupBy"):
            group.append(f["tagk"])
    name = q.get("aggregator", "none")
    df = df.select(TSID, *[F.col(f"`{t}`") for t in tags], ms.alias("ts"), F.col(FIELD).cast("double").alias("value"))
    if name == "none":
        return df.orderBy(F.asc_nulls_first(TSID), F.asc_nulls_first("ts")), tags
    if name not in AGGREGATORS:
        raise SchemaError(f"unsupported aggregator: {name}")
    group = list(dict.fromkeys(group))
    got = df.groupBy(*[F.col(f"`{t}`") for t in group], "ts").agg(AGGREGATORS[name]("value").cast("double").alias("value"))
    return got.orderBy(*[F.asc_nulls_first(F.col(f"`{t}`")) for t in group], "ts"), group


def series(df: DataFrame, metric: str, tags: list[str], aggregated: list[str] = ()) -> DataFrame:
    """(metric, tags, aggregatedTags, dps): a row for each series.

    ``dps`` are its points (ts, value) in order; append tables can have several points of a series at one time, so it is no map.
    """
    tags = sorted(tags)
    named = F.map_from_arrays(F.array(*map(F.lit, tags)), F.array(*[F.coalesce(F.col(f"`{t}`").cast("string"), F.lit("")) for t in tags])) if tags else F.expr("cast(map() as map<string,string>)")
    points = F.array_sort(F.collect_list(F.struct("ts", "value")))
    by = [F.col(f"`{t}`") for t in tags]
    got = df.groupBy(*by).agg(points.alias("points")).where("size(points) > 0")  # without tags, no rows are no series
    got = got.orderBy(*by) if by else got
    shared = F.array(*map(F.lit, aggregated)) if aggregated else F.array().cast("array<string>")
    return got.select(F.lit(metric).alias("metric"), named.alias("tags"), shared.alias("aggregatedTags"), F.col("points").alias("dps"))


def query(engine, request: dict | str) -> list[DataFrame]:
    """One DataFrame of series for each sub-query."""
    request = json.loads(request) if isinstance(request, str) else request
    out = []
    for q in request["queries"]:
        df, tags = sub_query(engine, q, int(request["start"]), int(request["end"]))
        out.append(series(df, q["metric"], tags, [] if q.get("aggregator", "none") == "none" else tags))
    return out


def respond(engine, request: dict | str) -> list[dict]:
    """The response: all series of all sub-queries; its ``dps`` are objects by time, so of points at one time the largest value stays."""
    return [{"metric": r.metric, "tags": r.tags, "aggregatedTags": r.aggregatedTags, "dps": {str(p.ts): p.value for p in r.dps}} for df in query(engine, request) for r in df.toLocalIterator()]
