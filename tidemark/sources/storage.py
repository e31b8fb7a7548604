"""Tables as Parquet directories: appended batches, overwrite by primary key, segments, partitions, expiry.

A table's folder holds ``_meta.json`` and a data folder, which the former names; data are
partitioned by segment (a slice of time) and, for partitioned tables, by partition.  Compaction
writes another data folder and then names that one.  Each write adds files with a batch number and a row
number; the larger pair is the later write.  Overwrite tables are reduced to the last write of
each key when they are read, by an aggregation that combines before it shuffles.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing
from ..schema import TSID, SchemaError, TableMeta

SEGMENT, PART, BATCH, ROW = "__seg", "__part", "__batch", "__row"
INTERNAL = (SEGMENT, PART, BATCH, ROW)


class Folder:
    """Small files beside the data, in any store that Arrow's file systems reach."""

    def __init__(self, root: str) -> None:
        self.root = re.sub("^file:/+", "file:///", root.rstrip("/"))
        self._fs, self._base = fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("/") else os.path.abspath(self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _at(self, name: str) -> str:
        return f"{self._base}/{name}" if name else self._base

    def exists(self, name: str) -> bool:
        return self._fs.get_file_info(self._at(name)).type != fs.FileType.NotFound

    def list(self, name: str = "", recursive: bool = False) -> list[str]:
        """Names in a folder; with ``recursive``, the paths of all files in it, hidden ones aside."""
        found = self._fs.get_file_info(fs.FileSelector(self._at(name), allow_not_found=True, recursive=recursive))
        if not recursive:
            return sorted(x.base_name for x in found)
        return sorted(x.path.removeprefix(self._at(name) + "/") for x in found if x.type == fs.FileType.File and x.base_name[0] not in "._")

    def read(self, name: str) -> str:
        with self._fs.open_input_stream(self._at(name)) as f:
            return f.read().decode()

    def write(self, name: str, text: str) -> None:
        """The whole file at once: what reads it meanwhile sees the old one or the new one."""
        self._fs.create_dir(self._at(os.path.dirname(name)), recursive=True)
        local = self._fs.type_name == "local"  # elsewhere a file appears when it is closed
        beside = f"{name}.new" if local else name
        with self._fs.open_output_stream(self._at(beside)) as f:
            f.write(text.encode())
        if local:
            self._fs.move(self._at(beside), self._at(name))  # replaces in one step

    def delete(self, name: str = "") -> None:
        kind = self._fs.get_file_info(self._at(name)).type
        if kind == fs.FileType.Directory:
            self._fs.delete_dir(self._at(name))
        elif kind == fs.FileType.File:
            self._fs.delete_file(self._at(name))


@dataclass
class TimeRange:
    """Milliseconds from ``start`` up to, not including, ``end``; None is unbounded."""

    start: int | None = None
    end: int | None = None

    def empty(self) -> bool:
        return self.start is not None and self.end is not None and self.start >= self.end

    def both(self, other: TimeRange) -> TimeRange:
        pick = lambda a, b, f: a if b is None else b if a is None else f(a, b)
        return TimeRange(pick(self.start, other.start, max), pick(self.end, other.end, min))

    def either(self, other: TimeRange) -> TimeRange:
        hull = lambda a, b, f: None if a is None or b is None else f(a, b)
        return TimeRange(hull(self.start, other.start, min), hull(self.end, other.end, max))


class Storage:
    """One table's files."""

    def __init__(self, spark: SparkSession, root: str, meta: TableMeta) -> None:
        self.spark, self.meta = spark, meta
        self.folder = Folder(root)

    def save_meta(self, data: str | None = None) -> None:
        """Write the table's schema and the name of its data folder, both at once."""
        self.folder.write("_meta.json", json.dumps({"table": self.meta.to_json(), "data": data or self.data}))

    @property
    def data(self) -> str:
        """The folder that holds the data now."""
        return json.loads(self.folder.read("_meta.json")).get("data", "data") if self.folder.exists("_meta.json") else "data"

    # ---- writing -------------------------------------------------------------------------

    def prepare(self, df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
        """Rows with all columns of the table, defaults and series id filled in, in the table's order and types, then ``extra``."""
        meta = self.meta
        given = set(df.columns) - set(extra)
        if unknown := given - {c.name for c in meta.columns}:
            raise SchemaError(f"unknown columns: {sorted(unknown)}")
        if TSID in given:
            raise SchemaError("tsid is made by the engine")
        for c in meta.columns:
            if c.name in given or c.name == TSID:
                continue
            if c.default is not None:
                df = df.withColumn(c.name, F.expr(c.default).cast(c.spark))  # may refer to the columns before it
            elif not c.nullable:
                raise SchemaError(f"a value is needed for {c.name}")
            else:
                df = df.withColumn(c.name, F.lit(None).cast(c.spark))
        df = df.select(*[(_to_timestamp(df[f"`{c.name}`"], df.schema[c.name].dataType) if c.kind == "timestamp" else F.col(f"`{c.name}`").cast(c.spark)).alias(c.name) for c in meta.columns if c.name != TSID], *extra)
        if meta.has(TSID):
            df = hashing.with_series_id(df, [(c.id, c.kind, c.name) for c in meta.tags])
        return df.select(*[F.col(f"`{c.name}`") for c in meta.columns], *extra)

    def append(self, df: DataFrame, batch: int | None = None, now_ms: int | None = None) -> None:
        """Write rows: expired ones are dropped, the rest goes to segments and partitions, sorted by key.

        A ``batch`` that was written whole isn't written again; what a failed attempt left of it goes first.
        """
        meta, data = self.meta, self.data
        if batch is not None:
            if self.folder.exists(f"_batches/{batch}.done"):
                return
            if self.folder.exists(f"_batches/{batch}.begun"):
                self._forget(batch)
            self.folder.write(f"_batches/{batch}.begun", "")
        rows = self.prepare(df.withColumn(ROW, F.monotonically_increasing_id()), (ROW,))  # numbered before any shuffle
        ms = F.unix_millis(F.col(f"`{meta.timestamp_key}`"))
        if meta.ttl_ms is not None:
            rows = rows.where(ms >= (now_ms if now_ms is not None else int(time.time() * 1000)) - meta.ttl_ms)
        rows = rows.withColumn(BATCH, F.lit(batch if batch is not None else time.time_ns()))
        rows = rows.withColumn(SEGMENT, F.floor(ms / meta.segment_ms))
        rows = self._partitioned(rows)
        by = [SEGMENT, *([PART] if meta.partitioning else [])]
        # a segment's rows go to a number of tasks that adaptive execution sets by their size
        out = rows.hint("rebalance", *by).sortWithinPartitions(*by, *[F.col(f"`{k}`") for k in meta.primary_key])
        writer = out.write.mode("append").partitionBy(*by).option("compression", self._codec())
        for c in [*meta.tags, *([meta.column(TSID)] if meta.has(TSID) else [])]:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c.name}", "true")
        writer.parquet(self.folder.path(data))
        if batch is not None:
            self.folder.write(f"_batches/{batch}.done", "")

    def _forget(self, batch: int) -> None:
        """Delete the files of a batch; a file holds rows of one batch until it is compacted, which only whole batches are."""
        found = self.files().where(F.col(BATCH) == batch).select(F.col("_metadata.file_path").alias("file")).distinct()
        for r in found.toLocalIterator():
            at = r.file.rfind(f"/{self.data}/")
            self.folder.delete(r.file[at + 1 :].replace("%3D", "="))

    def _codec(self) -> str:
        given = self.meta.option("compression").lower()
        return {"lz4": "lz4_raw"}.get(given, given)

    def _partitioned(self, rows: DataFrame) -> DataFrame:
        p = self.meta.partitioning
        if p is None:
            return rows
        if p.method == "random":  # the rows of a task go to one partition
            return rows.withColumn(PART, F.pmod(F.xxhash64(F.spark_partition_id(), F.lit(time.time_ns())), F.lit(p.partitions)).cast("int"))
        return hashing.with_partition(rows, [(self.meta.column(c).kind, c) for c in p.columns], p.partitions, PART)

    # ---- reading -------------------------------------------------------------------------

    def files(self) -> DataFrame:
        """All rows that were written, with batch and row numbers; columns added later are null in older files."""
        meta = self.meta
        fields = [T.StructField(c.name, c.spark) for c in meta.columns]
        fields += [T.StructField(BATCH, T.LongType()), T.StructField(ROW, T.LongType()), T.StructField(SEGMENT, T.LongType())]
        if meta.partitioning:
            fields.append(T.StructField(PART, T.IntegerType()))
        data = self.data
        if not self.folder.exists(data):
            return self.spark.createDataFrame([], T.StructType(fields))
        return self.spark.read.schema(T.StructType(fields)).parquet(self.folder.path(data))

    def scan(self, span: TimeRange | None = None, keys: dict[str, Iterable] | None = None) -> DataFrame:
        """The table's rows: the last write of each key, or all of an append table.

        ``span`` prunes segments and ``keys`` (values of key columns that the query asks for)
        prunes partitions; neither filters rows, which the query itself does.
        """
        df = self.files()
        if span is not None:
            if span.empty():
                df = df.limit(0)
            if span.start is not None:
                df = df.where(F.col(SEGMENT) >= span.start // self.meta.segment_ms)
            if span.end is not None:
                df = df.where(F.col(SEGMENT) <= (span.end - 1) // self.meta.segment_ms)
        if self.meta.partitioning and keys and (found := self.partitions(keys)) is not None:
            df = df.where(F.col(PART).isin(sorted(found)))
        if self.meta.overwrite:
            df = last_write(df, list(self.meta.primary_key), [c.name for c in self.meta.tags] if self.meta.has(TSID) and TSID in self.meta.primary_key else [])
        return df.select(*[F.col(f"`{c.name}`") for c in self.meta.columns])

    def partitions(self, keys: dict[str, Iterable]) -> set[int] | None:
        """Partitions that can hold rows with these key values; None for all."""
        p = self.meta.partitioning
        if p is None or p.method != "key" or any(c not in keys for c in p.columns):
            return None
        kinds = [self.meta.column(c).kind for c in p.columns]
        return {hashing.key_partition(list(zip(kinds, values, strict=True)), p.partitions) for values in itertools.product(*[list(keys[c]) for c in p.columns])}

    def get(self, key: dict, columns: list[str] | None = None) -> DataFrame:
        """At most one row: the one with this full primary key, given by tags where the key has a series id."""
        meta = self.meta
        need = [k for k in meta.primary_key if k != TSID] + ([TSID] if TSID in meta.primary_key and TSID in key else [])
        if any(key.get(k) is None for k in need):
            raise SchemaError("a full primary key without nulls is needed")
        df = self.scan()
        for k, v in key.items():
            c = F.col(f"`{k}`")
            df = df.where(F.unix_millis(c) == v if k == meta.timestamp_key and isinstance(v, int) else c == F.lit(v))
        return df.select(*[F.col(f"`{c}`") for c in columns or [c.name for c in meta.columns]]).limit(1)

    # ---- upkeep --------------------------------------------------------------------------

    def compact(self, now_ms: int | None = None) -> None:
        """Rewrite the table with the last write of each key in few sorted files; drop expired segments.

        Readers see the old data folder or the new one; files that came meanwhile make it fail, the table as it was.
        """
        old = self.data
        if not self.folder.exists(old):
            return
        self.expire(now_ms)
        had = self.folder.list(old, recursive=True)
        if not had:
            return
        new = f"data-{int(old.removeprefix('data').removeprefix('-') or 0) + 1}"
        self._rewritten(self.files()).parquet(self.folder.path(new), mode="overwrite")
        if self.folder.list(old, recursive=True) != had:
            self.folder.delete(new)
            raise SchemaError(f"{self.meta.name} was written to while it was compacted")
        self.save_meta(new)
        self.folder.delete(old)

    def _rewritten(self, df: DataFrame):
        """A writer of the last write of each key, or of all rows, by segment and partition."""
        by = [SEGMENT, *([PART] if self.meta.partitioning else [])]
        if self.meta.overwrite:
            df = last_write(df, list(self.meta.primary_key), [], keep=(BATCH, ROW, *by))
        out = df.select(*[F.col(f"`{c.name}`") for c in self.meta.columns], BATCH, ROW, *by).hint("rebalance", *by)
        return out.sortWithinPartitions(*by, *[F.col(f"`{k}`") for k in self.meta.primary_key]).write.partitionBy(*by).option("compression", self._codec())

    def file_stats(self) -> DataFrame:
        """(file, bytes, rows, first, last): what each data file holds, times in milliseconds."""
        ms = F.unix_millis(F.col(f"`{self.meta.timestamp_key}`"))
        df = self.files().select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), ms.alias("ms"))
        return df.groupBy("file", "bytes").agg(F.count("*").alias("rows"), F.min("ms").alias("first"), F.max("ms").alias("last"))

    def expire(self, now_ms: int | None = None) -> list[str]:
        """Delete segments whose end lies before the time to live."""
        if self.meta.ttl_ms is None:
            return []
        last = (now_ms if now_ms is not None else int(time.time() * 1000)) - self.meta.ttl_ms
        gone = []
        data = self.data
        for name in self.folder.list(data):
            if name.startswith(f"{SEGMENT}=") and (int(name.split("=")[1]) + 1) * self.meta.segment_ms <= last:
                self.folder.delete(f"{data}/{name}")
                gone.append(name)
        return gone


def _to_timestamp(c: Column, given: T.DataType) -> Column:
    """Numbers are milliseconds of the epoch; finer timestamps lose what is below milliseconds."""
    if isinstance(given, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return F.timestamp_millis(c.cast("long"))
    return F.timestamp_millis(F.unix_millis(c.cast("timestamp")))


def last_write(df: DataFrame, key: list[str], dependent: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The whole row of the last write of each key.

    A partial aggregation; filters on the key reach the scan, filters on other columns stay
    above.  ``dependent`` are columns that the key determines: grouping by them, too, lets
    filters on them pass.
    """
    by = [*key, *[c for c in dependent or [] if c not in key]]
    rest = [c for c in df.columns if c not in by and (c in keep or c not in INTERNAL)]
    order = F.struct(F.col(BATCH), F.col(ROW))
    if not rest:
        return df.groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.max(order).alias("__last")).drop("__last")
    last = df.groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("__row_"))
    return last.select(*[F.col(f"`{c}`") for c in by], *[F.col("__row_")[c].alias(c) for c in rest])


def sample_segment_ms(df: DataFrame, ts: str, series: list[str]) -> int:
    """A segment duration from the data: the first step longer than a hundred of the 90th percentile interval."""
    from pyspark.sql import Window

    from ..schema import SEGMENT_STEPS_MS

    gap = F.unix_millis(ts) - F.lag(F.unix_millis(ts)).over(Window.partitionBy(*series).orderBy(ts))
    wide = df.select(gap.alias("gap")).where("gap > 0").agg(F.percentile_approx("gap", 0.9).alias("p")).first()["p"]
    span = (wide or 0) * 100
    return next((s for s in SEGMENT_STEPS_MS if s > span), SEGMENT_STEPS_MS[-1])


def sample_primary_key(df: DataFrame, meta: TableMeta) -> list[str]:
    """A sort order from the data: the two columns with the fewest distinct values, then series and time."""
    from ..schema import NOT_KEYS

    names = [c.name for c in meta.columns if c.kind not in NOT_KEYS and c.name not in (TSID, meta.timestamp_key)]
    if not names:
        return [TSID, meta.timestamp_key]
    counts = df.agg(*[F.approx_count_distinct(F.col(f"`{n}`")).alias(n) for n in names]).first().asDict()
    return [*sorted(names, key=lambda n: (counts[n], names.index(n)))[:2], TSID, meta.timestamp_key]
