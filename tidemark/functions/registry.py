"""A registry of functions: names to column builders, scalar and aggregate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession


@dataclass(frozen=True)
class Signature:
    """What arguments a function takes: exact types in order, any number of one type, or one of several signatures."""

    exact: tuple[str, ...] | None = None
    uniform: tuple[int, tuple[str, ...]] | None = None
    one_of: tuple[Signature, ...] = ()

    def accepts(self, types: list[str]) -> bool:
        if self.one_of:
            return any(s.accepts(types) for s in self.one_of)
        if self.exact is not None:
            return list(self.exact) == types
        if self.uniform is not None:
            n, allowed = self.uniform
            return len(types) == n and len(set(types)) == 1 and types[0] in allowed
        return True


@dataclass
class Registry:
    """Functions by name; a name can be taken once."""

    scalars: dict[str, tuple[Callable[..., Column], Signature]] = field(default_factory=dict)
    aggregates: dict[str, tuple[Callable[..., Column], Signature]] = field(default_factory=dict)

    def register(self, name: str, build: Callable[..., Column], signature: Signature | None = None, aggregate: bool = False) -> None:
        if name in self.scalars or name in self.aggregates:
            raise ValueError(f"function already registered: {name}")
        (self.aggregates if aggregate else self.scalars)[name] = (build, signature or Signature())

    def find(self, name: str) -> Callable[..., Column]:
        found = self.scalars.get(name) or self.aggregates.get(name)
        if found is None:
            raise KeyError(f"no such function: {name}")
        return found[0]

    def call(self, name: str, *args: Column, types: list[str] | None = None) -> Column:
        build, signature = self.scalars.get(name) or self.aggregates[name]
        if types is not None and not signature.accepts(types):
            raise TypeError(f"{name} doesn't take {types}")
        return build(*args)

    def names(self) -> list[str]:
        return sorted([*self.scalars, *self.aggregates])


def register_udf(spark: SparkSession, registry: Registry, name: str, fn, returns: str, aggregate: bool = False) -> None:
    """A Python function as a vectorised UDF, by name in SQL and in the registry."""
    from pyspark.sql import functions as F

    udf = F.pandas_udf(fn, returns)
    registry.register(name, udf, aggregate=aggregate)
    spark.udf.register(name, udf)


def default_registry() -> Registry:
    from . import scalars, timeseries

    r = Registry()
    r.register("time_bucket", timeseries.time_bucket)
    r.register("date_bin", timeseries.date_bin)
    r.register("regex_match", timeseries.regex_match)
    r.register("regex_not_match", lambda x, p: ~timeseries.regex_match(x, p))
    r.register("thetasketch_distinct", timeseries.thetasketch_distinct, aggregate=True)
    for name, build in scalars.FUNCTIONS.items():
        r.register(name, build)
    return r
