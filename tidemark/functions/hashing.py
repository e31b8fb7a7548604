"""Series ids, unique ids and partition numbers: MurmurHash3 (x64, 128 bits) over compact encodings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timezone
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_M = (1 << 64) - 1
# Multipliers and finalizers of MurmurHash3 x64 128.
_C1, _C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
_F1, _F2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
# Type flags of the compact encoding.
FLAG_BYTES, FLAG_INT, FLAG_UINT = 2, 8, 9
UNSIGNED = {"uint64", "uint32", "uint16", "uint8", "boolean"}
SIGNED = {"bigint", "int", "smallint", "tinyint", "timestamp", "date", "time"}
#: Bytes of a number in partition keys.
WIDTH = {"uint64": 8, "uint32": 4, "uint16": 2, "uint8": 1, "bigint": 8, "int": 4, "smallint": 2, "tinyint": 1, "timestamp": 8, "date": 4, "time": 8, "boolean": 1}


def _rotl(x: int, r: int) -> int:
    return (x << r | x >> (64 - r)) & _M


def _final(x: int) -> int:
    x = (x ^ x >> 33) * _F1 & _M
    x = (x ^ x >> 33) * _F2 & _M
    return x ^ x >> 33


def murmur64(data: bytes) -> int:
    """The low 64 bits of MurmurHash3 x64 128 with seed 0."""
    h1 = h2 = 0
    body = len(data) // 16 * 16
    for i in range(0, body, 16):
        k1, k2 = int.from_bytes(data[i : i + 8], "little"), int.from_bytes(data[i + 8 : i + 16], "little")
        h1 ^= _rotl(k1 * _C1 & _M, 31) * _C2 & _M
        h1 = ((_rotl(h1, 27) + h2) * 5 + 0x52DCE729) & _M
        h2 ^= _rotl(k2 * _C2 & _M, 33) * _C1 & _M
        h2 = ((_rotl(h2, 31) + h1) * 5 + 0x38495AB5) & _M
    tail = data[body:]
    if len(tail) > 8:
        h2 ^= _rotl(int.from_bytes(tail[8:], "little") * _C2 & _M, 33) * _C1 & _M
    if tail:
        h1 ^= _rotl(int.from_bytes(tail[:8], "little") * _C1 & _M, 31) * _C2 & _M
    h1 ^= len(data)
    h2 ^= len(data)
    h1 = (h1 + h2) & _M
    h2 = (h2 + h1) & _M
    h1, h2 = _final(h1), _final(h2)
    return (h1 + h2) & _M


def uvarint(x: int) -> bytes:
    out = bytearray()
    while x >= 0x80:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    return bytes([*out, x])


def varint(x: int) -> bytes:
    return uvarint((x << 1 ^ x >> 63) & _M)


def as_int(value, kind: str) -> int:
    """The integer that stands for a value of an integral kind."""
    if isinstance(value, (datetime, pd.Timestamp)):
        value = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        return int(value.timestamp() * 1000)
    if isinstance(value, date):
        return value.toordinal() - date(1970, 1, 1).toordinal()
    return int(value)


def as_bytes(value) -> bytes:
    return value.encode() if isinstance(value, str) else bytes(value)


def encode(value, kind: str) -> bytes:
    """Flag and payload of one value."""
    if kind in UNSIGNED:
        return bytes([FLAG_UINT]) + uvarint(as_int(value, kind))
    if kind in SIGNED:
        return bytes([FLAG_INT]) + varint(as_int(value, kind))
    if kind in ("string", "varbinary"):
        raw = as_bytes(value)
        return bytes([FLAG_BYTES]) + varint(len(raw)) + raw
    raise ValueError(f"values of kind {kind} can't be part of a series id")


def series_id(tags: Sequence[tuple[int, str, object]]) -> int:
    """The id of the series with the tags (column id, kind, value), in column order; null tags don't count."""
    data = b"".join(encode(i, "uint64") + encode(v, k) for i, k, v in tags if v is not None)
    return murmur64(data) if data else 0


def unique_id(labels: Sequence) -> int:
    """The id of a set of labels; a null label is the empty string."""
    return murmur64(b"".join(varint(len(raw)) + raw for raw in (as_bytes(v if v is not None else "") for v in labels)))


def key_bytes(value, kind: str) -> bytes:
    """Bytes of a value in a partition key."""
    if value is None:
        return b""
    if kind in WIDTH:
        return (as_int(value, kind) & (1 << 8 * WIDTH[kind]) - 1).to_bytes(WIDTH[kind], "little")
    return as_bytes(value)


def key_partition(values: Sequence[tuple[str, object]], partitions: int) -> int:
    """The partition of a row by its key values (kind, value)."""
    return murmur64(b"".join(key_bytes(v, k) for k, v in values)) % partitions


def unsigned(column: Column) -> Column:
    """A long's bits read as an unsigned number."""
    d = column.cast("decimal(20,0)")
    return F.when(column < 0, d + F.lit(Decimal(1 << 64)).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _over_distinct(df: DataFrame, columns: list[str], fn, name: str, result: str) -> DataFrame:
    """``df`` with ``name``, computed once for each distinct tuple of ``columns`` and joined back.

    The tuples are as many as the series, far fewer than the rows; a series with most of the
    rows is split by the skew join, and its tuple is one row on the other side.
    """
    if not columns:
        return df.withColumn(name, F.lit(0).cast(result))

    @F.pandas_udf(result)
    def hashed(*series: pd.Series) -> pd.Series:
        return pd.Series([fn(row) for row in zip(*(s.astype(object).where(s.notna(), None) for s in series), strict=True)], dtype="int64")

    pairs = [(c, f"__k{i}") for i, c in enumerate(columns)]
    keys = df.select(*[F.col(f"`{c}`").alias(k) for c, k in pairs]).distinct()
    keys = keys.withColumn(name, hashed(*[F.col(k) for _, k in pairs]))
    on = F.lit(True)
    for c, k in pairs:
        on = on & df[f"`{c}`"].eqNullSafe(keys[k])
    return df.join(keys, on, "left").drop(*[k for _, k in pairs])


def with_series_id(df: DataFrame, tags: list[tuple[int, str, str]], name: str = "tsid") -> DataFrame:
    """``df`` with the series id of the tags (column id, kind, column), an unsigned number."""
    tags = sorted(tags)

    def of(row) -> int:
        return _signed(series_id([(i, k, v) for (i, k, _), v in zip(tags, row, strict=True)]))

    return _over_distinct(df, [c for _, _, c in tags], of, name, "long").withColumn(name, unsigned(F.col(name)))


def with_unique_id(df: DataFrame, labels: list[str], name: str = "tsid") -> DataFrame:
    """``df`` with the id of its label values."""
    return _over_distinct(df, labels, lambda row: _signed(unique_id(row)), name, "long").withColumn(name, unsigned(F.col(name)))


def with_partition(df: DataFrame, keys: list[tuple[str, str]], partitions: int, name: str = "__part") -> DataFrame:
    """``df`` with the partition of the key columns (kind, column)."""
    kinds = [k for k, _ in keys]
    return _over_distinct(df, [c for _, c in keys], lambda row: key_partition(list(zip(kinds, row, strict=True)), partitions), name, "long").withColumn(name, F.col(name).cast("int"))
