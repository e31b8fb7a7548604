"""Scalar functions without a twin of the same name and meaning in Spark, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor, by Euclid's steps; 93 are enough for 64 bits."""
    zero = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("long")).otherwise(s["x"] % s["y"]).alias("y"))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(93)), zero, step, lambda s: s["x"]))


def lcm(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise((F.abs(a.cast("long")) / gcd(a, b)).cast("long") * F.abs(b.cast("long")))


def trunc(x: Column, n: Column | int = 0) -> Column:
    """Toward zero, at ``n`` decimals."""
    scale = F.pow(F.lit(10.0), n if isinstance(n, Column) else F.lit(n))
    return F.sign(x) * F.floor(F.abs(x) * scale) / scale


def iszero(x: Column) -> Column:
    return x == 0


def log(x: Column) -> Column:
    """To base ten."""
    return F.log10(x)


def strpos(s: Column, sub: Column) -> Column:
    return F.locate_column(s, sub) if hasattr(F, "locate_column") else F.position(sub, s)


def to_hex(x: Column) -> Column:
    return F.lower(F.hex(x.cast("long")))


def substr_index(s: Column, delim: Column, n: Column) -> Column:
    return F.call_function("substring_index", s, delim, n)


def sha224(x: Column) -> Column:
    return F.sha2(x, 224)


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def sha384(x: Column) -> Column:
    return F.sha2(x, 384)


def sha512(x: Column) -> Column:
    return F.sha2(x, 512)


def digest(x: Column, method: str) -> Column:
    if method == "md5":
        return F.md5(x)
    return F.sha2(x, int(method.removeprefix("sha")))


def encode(x: Column, form: str) -> Column:
    return F.base64(x) if form == "base64" else F.lower(F.hex(x))


def decode(x: Column, form: str) -> Column:
    return F.unbase64(x) if form == "base64" else F.unhex(x)


def regexp_match(s: Column, pattern: Column) -> Column:
    """The first match's groups (or the match), null if there is none."""
    return F.when(F.regexp_like(s, pattern), F.array(F.regexp_substr(s, pattern)))


def to_timestamp_nanos(x: Column) -> Column:
    return F.timestamp_micros((x.cast("long") / 1000).cast("long"))


def array_positions(a: Column, x: Column) -> Column:
    return F.filter(F.transform(a, lambda v, i: F.when(v.eqNullSafe(x), i + 1)), lambda i: i.isNotNull())


def array_remove_n(a: Column, x: Column, n: Column) -> Column:
    at = array_positions(a, x)
    return F.filter(F.transform(a, lambda v, i: F.struct(v.alias("v"), (~F.array_contains(F.slice(at, F.lit(1), n), i + 1)).alias("keep"))), lambda s: s["keep"])["v"]


def array_replace_all(a: Column, old: Column, new: Column) -> Column:
    return F.transform(a, lambda v: F.when(v.eqNullSafe(old), new).otherwise(v))


def array_pop_back(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def array_pop_front(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a), F.lit(0)))


def array_has_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def array_repeat_all(x: Column, n: Column) -> Column:
    return F.array_repeat(x, n)


FUNCTIONS = {
    "gcd": gcd, "lcm": lcm, "trunc": trunc, "iszero": iszero, "log": log, "strpos": strpos, "to_hex": to_hex, "substr_index": substr_index,
    "sha224": sha224, "sha256": sha256, "sha384": sha384, "sha512": sha512, "digest": digest, "encode": encode, "decode": decode,
    "regexp_match": regexp_match, "to_timestamp_nanos": to_timestamp_nanos, "array_positions": array_positions, "array_remove_n": array_remove_n,
    "array_replace_all": array_replace_all, "array_pop_back": array_pop_back, "array_pop_front": array_pop_front,
    "array_has_all": array_has_all, "array_has_any": F.arrays_overlap, "make_array": F.array, "array_to_string": F.array_join, "cardinality": F.size,
}
