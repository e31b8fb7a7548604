"""Session settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change answers; all can be set on a live session.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "false",
    "spark.sql.ansi.doubleQuotedIdentifiers": "false",
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the engine's settings to ``spark``."""
    for key, value in SEMANTICS.items():
        spark.conf.set(key, value)
    return spark


def engine_session(spark: SparkSession) -> SparkSession:
    """A session of its own over the same context, so that the engine's settings stay in it."""
    return configure(spark.newSession())
