"""What is checked before a query runs: blocked tables, limits, priority, deadlines."""

from __future__ import annotations

import threading
from contextlib import contextmanager
from dataclasses import dataclass, field
from enum import Enum

from .sources.storage import TimeRange

#: Ranges of this many milliseconds and more, and unbounded ones, have low priority.
EXPENSIVE_MS = 24 * 3_600_000


class Priority(Enum):
    """The value is the scheduler pool."""

    HIGH = "high"
    LOW = "low"
    EMPTY = "none"


def priority_of(span: TimeRange, expensive_ms: int = EXPENSIVE_MS) -> Priority:
    """EMPTY means that no row can match, so nothing needs to run."""
    if span.empty():
        return Priority.EMPTY
    if span.start is None or span.end is None or span.end - span.start >= expensive_ms:
        return Priority.LOW
    return Priority.HIGH


class Blocked(PermissionError):
    """A statement that the limiter doesn't let through."""


@dataclass
class Limiter:
    """Tables whose reads or writes are blocked, and rules that block queries on any table.

    Rules: ``"any_query"``, ``"any_insert"``, ``"query_without_predicate"``, ``("query_range", milliseconds)``.
    """

    block_reads: set[str] = field(default_factory=set)
    block_writes: set[str] = field(default_factory=set)
    rules: list = field(default_factory=list)

    def check_query(self, table: str, span: TimeRange, has_predicate: bool) -> None:
        if table in self.block_reads:
            raise Blocked(f"queries on {table} are blocked")
        for rule in self.rules:
            if rule == "any_query":
                raise Blocked("queries are blocked")
            if rule == "query_without_predicate" and not has_predicate:
                raise Blocked("queries without a predicate are blocked")
            if isinstance(rule, tuple) and rule[0] == "query_range" and (span.start is None or span.end is None or span.end - span.start >= rule[1]):
                raise Blocked("queries over such a range are blocked")

    def check_insert(self, table: str) -> None:
        if table in self.block_writes or "any_insert" in self.rules:
            raise Blocked(f"writes to {table} are blocked")


@contextmanager
def deadline(spark, seconds: float, group: str = "tidemark-deadline"):
    """Cancels the jobs that are started inside when the time is over."""
    sc = spark.sparkContext
    sc.setJobGroup(group, "runs under a deadline", interruptOnCancel=True)
    timer = threading.Timer(seconds, lambda: sc.cancelJobGroup(group))
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
