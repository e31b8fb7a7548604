"""Continuous ingestion: a stream of rows or lines into tables, a micro-batch at a time.

A batch's number orders its writes, so of two rows with the same key the one of the later
batch wins, and a batch that is run again after a failure writes rows that lose against none
but themselves.  Offsets and batch numbers live in the query's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources import protocols

#: Batch numbers of streams lie above the clock-based ones of single writes made before the stream began.
STRIDE = 1 << 20


def _start(stream: DataFrame, write, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def into_table(engine, stream: DataFrame, table: str, tags: list[str], checkpoint: str, timestamp: str = "timestamp", base: int = 0, trigger: dict | None = None) -> StreamingQuery:
    """Write a stream of rows into a table, which is made or widened as needed; expired rows are dropped on the way."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            engine.ingest(table, batch, tags, timestamp, batch=base + number)

    return _start(stream, write, checkpoint, trigger)


def lines_into_tables(engine, stream: DataFrame, checkpoint: str, precision: str = "ms", base: int = 0, trigger: dict | None = None) -> StreamingQuery:
    """Write a stream of line protocol (column ``value``) into the tables of its measurements."""

    def write(batch: DataFrame, number: int) -> None:
        protocols.write_lines(engine, protocols.parse_lines(batch, precision), batch=base + number)

    return _start(stream, write, checkpoint, trigger)


def tumbling(stream: DataFrame, ts: str, width: str, by: list[str], late: str, **aggregates) -> DataFrame:
    """Aggregates by tumbling window; rows later than ``late`` behind the newest are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
