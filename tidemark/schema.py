"""Columns, tables and their options: what DDL declares and ingest infers."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, replace
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# SQL spellings of the kinds.
SPELLINGS = {
    "timestamp": "timestamp", "double": "double", "float": "float", "real": "float", "varbinary": "varbinary", "string": "string",
    "uint64": "uint64", "uint32": "uint32", "uint16": "uint16", "uint8": "uint8",
    "bigint": "bigint", "int64": "bigint", "int": "int", "integer": "int", "int32": "int", "smallint": "smallint", "int16": "smallint", "tinyint": "tinyint", "int8": "tinyint",
    "boolean": "boolean", "date": "date", "time": "time",
}
UNSIGN = {"bigint": "uint64", "int": "uint32", "smallint": "uint16", "tinyint": "uint8"}
SPARK_TYPES = {
    "timestamp": T.TimestampType(), "double": T.DoubleType(), "float": T.FloatType(), "varbinary": T.BinaryType(), "string": T.StringType(),
    "uint64": T.DecimalType(20, 0), "uint32": T.LongType(), "uint16": T.IntegerType(), "uint8": T.ShortType(),
    "bigint": T.LongType(), "int": T.IntegerType(), "smallint": T.ShortType(), "tinyint": T.ByteType(), "boolean": T.BooleanType(), "date": T.DateType(), "time": T.LongType(),
}
RANGES = {
    "uint64": (0, (1 << 64) - 1), "uint32": (0, (1 << 32) - 1), "uint16": (0, (1 << 16) - 1), "uint8": (0, 255),
    "bigint": (-(1 << 63), (1 << 63) - 1), "int": (-(1 << 31), (1 << 31) - 1), "smallint": (-(1 << 15), (1 << 15) - 1), "tinyint": (-128, 127),
}
NOT_KEYS = {"double", "float"}
# Option defaults, as they are shown.
OPTIONS = {
    "arena_block_size": "2097152", "compaction_strategy": "default", "compression": "ZSTD", "enable_ttl": "true", "memtable_type": "skiplist", "num_rows_per_row_group": "8192",
    "segment_duration": "", "storage_format": "AUTO", "ttl": "7d", "update_mode": "OVERWRITE", "write_buffer_size": "33554432",
}
IMMUTABLE = {"segment_duration", "update_mode", "storage_format"}
SEGMENT_STEPS_MS = [h * 3_600_000 for h in (2, 24, 7 * 24, 30 * 24, 180 * 24, 360 * 24, 1800 * 24, 3600 * 24)]
TSID = "tsid"


class SchemaError(ValueError):
    """A table or a value that the schema doesn't allow."""


def kind_of(spelling: str, unsign: bool = False) -> str:
    kind = SPELLINGS.get(spelling.lower())
    if kind is None or unsign and kind not in UNSIGN:
        raise SchemaError(f"unsupported type: {spelling}")
    return UNSIGN[kind] if unsign else kind


def duration_ms(text: str) -> int:
    """Milliseconds of a duration such as 7d, 2h or 30m."""
    m = re.fullmatch(r"([0-9]+)\s*(ms|s|m|h|d)", text.strip())
    if not m:
        raise SchemaError(f"not a duration: {text}")
    return int(m[1]) * {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}[m[2]]


@dataclass(frozen=True)
class ColumnMeta:
    name: str
    kind: str
    id: int = 0
    nullable: bool = True
    tag: bool = False
    dictionary: bool = False
    comment: str = ""
    default: str | None = None

    def __post_init__(self) -> None:
        if self.dictionary and self.kind != "string":
            raise SchemaError("only string columns can be dictionaries")
        if self.tag and self.kind in NOT_KEYS:
            raise SchemaError(f"a {self.kind} column can't be a tag")

    @property
    def spark(self) -> T.DataType:
        return SPARK_TYPES[self.kind]

    def ddl(self) -> str:
        parts = [f"`{self.name}` {self.kind}"]
        if self.tag:
            parts.append("TAG")
        if self.dictionary:
            parts.append("DICTIONARY")
        if not self.nullable:
            parts.append("NOT NULL")
        if self.default is not None:
            parts.append(f"DEFAULT {self.default}")
        if self.comment:
            parts.append(f"COMMENT '{self.comment}'")
        return " ".join(parts)


@dataclass(frozen=True)
class Partitioning:
    method: str  # key, random, hash
    columns: tuple[str, ...] = ()
    partitions: int = 1
    linear: bool = False


@dataclass(frozen=True)
class TableMeta:
    name: str
    columns: tuple[ColumnMeta, ...]
    primary_key: tuple[str, ...]
    timestamp_key: str
    engine: str = "Analytic"
    options: dict = field(default_factory=dict)
    partitioning: Partitioning | None = None
    version: int = 1

    def column(self, name: str) -> ColumnMeta:
        for c in self.columns:
            if c.name == name:
                return c
        raise SchemaError(f"no such column: {name}")

    def has(self, name: str) -> bool:
        return any(c.name == name for c in self.columns)

    def option(self, name: str) -> str:
        return self.options.get(name, OPTIONS[name])

    @property
    def tags(self) -> list[ColumnMeta]:
        return [c for c in self.columns if c.tag]

    @property
    def fields(self) -> list[ColumnMeta]:
        return [c for c in self.columns if not c.tag and c.name not in (TSID, self.timestamp_key)]

    @property
    def overwrite(self) -> bool:
        return self.option("update_mode").upper() == "OVERWRITE"

    @property
    def segment_ms(self) -> int:
        given = self.option("segment_duration")
        return duration_ms(given) if given else SEGMENT_STEPS_MS[0]

    @property
    def ttl_ms(self) -> int | None:
        """Whole days, or None if rows don't expire."""
        if self.option("enable_ttl").lower() != "true":
            return None
        return duration_ms(self.option("ttl")) // 86_400_000 * 86_400_000

    @property
    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark, True) for c in self.columns])

    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, raw: dict) -> TableMeta:
        part = raw["partitioning"]
        return cls(
            **raw | {
                "columns": tuple(ColumnMeta(**c) for c in raw["columns"]), "primary_key": tuple(raw["primary_key"]),
                "partitioning": part and Partitioning(part["method"], tuple(part["columns"]), part["partitions"], part["linear"]),
            }
        )

    def show_create(self) -> str:
        columns = ", ".join(c.ddl() for c in self.columns)
        options = ", ".join(f"{k}='{self.option(k)}'" for k in sorted(OPTIONS))
        part = ""
        if p := self.partitioning:
            by = f"({', '.join(p.columns)})" if p.columns else ""
            part = f" PARTITION BY {'LINEAR ' if p.linear else ''}{p.method.upper()}{by} PARTITIONS {p.partitions}"
        return f"CREATE TABLE `{self.name}` ({columns}, PRIMARY KEY({','.join(self.primary_key)}), TIMESTAMP KEY({self.timestamp_key})){part} ENGINE={self.engine} WITH({options})"


def make_table(
    name: str, columns: list[ColumnMeta], timestamp_key: str | None = None, primary_key: list[str] | None = None, options: dict | None = None,
    partitioning: Partitioning | None = None, engine: str = "Analytic",
) -> TableMeta:
    """A checked table: key columns first, ids from one, a series id where the key has one."""
    options = {k.lower(): str(v) for k, v in (options or {}).items()}
    if unknown := set(options) - set(OPTIONS):
        raise SchemaError(f"unknown options: {sorted(unknown)}")
    if options.get("storage_format", "").upper() == "HYBRID":
        raise SchemaError("the hybrid storage format isn't supported")
    if "storage_format" in options:
        options["storage_format"] = options["storage_format"].upper()
    if "update_mode" in options:
        options["update_mode"] = options["update_mode"].upper()
        if options["update_mode"] not in ("OVERWRITE", "APPEND"):
            raise SchemaError(f"unknown update mode: {options['update_mode']}")
    if "num_rows_per_row_group" in options:
        options["num_rows_per_row_group"] = str(min(10_000_000, max(100, int(options["num_rows_per_row_group"]))))
    names = [c.name for c in columns]
    if len(set(names)) < len(names):
        raise SchemaError("a column is declared twice")
    if TSID in names:
        raise SchemaError("tsid is reserved")
    if timestamp_key is None:
        found = [c.name for c in columns if c.kind == "timestamp"]
        if len(found) != 1:
            raise SchemaError("Table must contain timestamp constraint")
        timestamp_key = found[0]
    by_name = {c.name: c for c in columns}
    if timestamp_key not in by_name or by_name[timestamp_key].kind != "timestamp":
        raise SchemaError("the timestamp key has to be a timestamp column")
    key = primary_key or [TSID, timestamp_key]
    if timestamp_key not in key:
        raise SchemaError("the primary key has to contain the timestamp key")
    for k in key:
        if k != TSID and k not in by_name:
            raise SchemaError(f"no such key column: {k}")
        if k != TSID and by_name[k].kind in NOT_KEYS:
            raise SchemaError(f"a {by_name[k].kind} column can't be in the key")
    if partitioning:
        if partitioning.method == "hash":
            raise SchemaError("hash partitioning can be parsed, but no table can be created with it")
        if partitioning.method == "random" and options.get("update_mode", "OVERWRITE") == "OVERWRITE":
            raise SchemaError("random partitions can't be overwritten; use update_mode='APPEND'")
        for c in partitioning.columns:
            if c not in by_name or not by_name[c].tag:
                raise SchemaError(f"a partition key has to be a tag: {c}")
    series = ColumnMeta(TSID, "uint64", nullable=False)
    keys = [series if k == TSID else replace(by_name[k], nullable=False) for k in key]
    ordered = [*keys, *[c for c in columns if c.name not in key]]
    return TableMeta(name, tuple(replace(c, id=i + 1) for i, c in enumerate(ordered)), tuple(key), timestamp_key, engine, options, partitioning)


def infer_table(name: str, tags: dict[str, str], fields: dict[str, str], timestamp_key: str = "timestamp") -> TableMeta:
    """A table for rows that came without one: the key, then tags and fields together, by name."""
    rest = [ColumnMeta(n, k, tag=n in tags) for n, k in sorted({**fields, **tags}.items())]
    return make_table(name, [ColumnMeta(timestamp_key, "timestamp", nullable=False), *rest], timestamp_key)


def add_columns(table: TableMeta, columns: list[ColumnMeta]) -> TableMeta:
    """The table with nullable columns at its end, new ids and the next version."""
    for c in columns:
        if not c.nullable:
            raise SchemaError(f"a column that is added has to be nullable: {c.name}")
        if table.has(c.name):
            raise SchemaError(f"column exists: {c.name}")
    last = max(c.id for c in table.columns)
    return replace(table, columns=(*table.columns, *[replace(c, id=last + i + 1) for i, c in enumerate(columns)]), version=table.version + 1)


def modify_options(table: TableMeta, options: dict) -> TableMeta:
    options = {k.lower(): str(v) for k, v in options.items()}
    for k in options:
        if k not in OPTIONS:
            raise SchemaError(f"unknown option: {k}")
        if k in IMMUTABLE:
            raise SchemaError(f"option can't change: {k}")
    return replace(table, options=table.options | options, version=table.version + 1)


def parse_value(value, kind: str):
    """A literal as a value of ``kind``: the Python value that Spark stores."""
    if value is None:
        raise SchemaError("a null literal isn't allowed; leave the column out instead")
    if kind in RANGES:
        if isinstance(value, bool) or not isinstance(value, int):
            try:
                value = int(str(value))
            except ValueError as e:
                raise SchemaError(f"not a number of kind {kind}: {value!r}") from e
        low, high = RANGES[kind]
        if not low <= value <= high:
            raise SchemaError(f"out of range for {kind}: {value}")
        return value
    if kind in ("double", "float"):
        return float(value)
    if kind == "string":
        if not isinstance(value, str):
            raise SchemaError(f"not a string: {value!r}")
        return value
    if kind == "varbinary":
        return value.encode() if isinstance(value, str) else bytes(value)
    if kind == "boolean":
        if isinstance(value, bool):
            return value
        if str(value).lower() in ("true", "false"):
            return str(value).lower() == "true"
        raise SchemaError(f"not a boolean: {value!r}")
    if kind == "timestamp":
        return int(value)
    if kind == "date":
        return date.fromisoformat(value)
    if kind == "time":
        return time_ns(value)
    raise SchemaError(f"no values of kind {kind}")


def time_ns(text: str) -> int:
    """Nanoseconds of a time of day such as 12:30:15.250; hours may go to 838, with a sign."""
    m = re.fullmatch(r"(-?)([0-9]{1,3}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,9}))?", text)
    if not m or int(m[2]) > 838 or int(m[3]) > 59 or int(m[4]) > 59:
        raise SchemaError(f"not a time: {text}")
    ns = int(timedelta(hours=int(m[2]), minutes=int(m[3]), seconds=int(m[4])).total_seconds()) * 10**9 + int((m[5] or "").ljust(9, "0"))
    return -ns if m[1] else ns


def wrapped(x: Column, kind: str) -> Column:
    """Unsigned arithmetic: the value modulo two to the number of bits."""
    low, high = RANGES[kind]
    width = F.lit(str(high - low + 1)).cast("decimal(38,0)")
    return F.pmod(x.cast("decimal(38,0)"), width).cast(SPARK_TYPES[kind])
