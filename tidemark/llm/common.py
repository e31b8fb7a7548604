"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: Rows of text turned into Python objects at once, whatever the Arrow batch holds.
SLICE_ROWS = 256
#: Bytes of text after which a slice is closed early, so that long documents stay few at a time.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch on its way to a worker; both sides hold a few of them.
BATCH_BYTES = 2 << 20
#: Rows to a file of a written table of a few short columns.
FILE_ROWS = 500_000
#: Rows of a few short columns that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; choose one only for a local session without any (tests, benchmarks)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    sc.setCheckpointDir(folder)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def narrow(df: DataFrame) -> tuple[DataFrame, int]:
    """Write a table of a few short columns to the checkpoint folder in as few files as its rows need; with the number of rows."""
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        rows = kept.count()
        return materialize(kept.coalesce(max(1, -(-rows // FILE_ROWS)))), rows
    finally:
        kept.unpersist()


def picked(df: DataFrame, keys: DataFrame, rows: int, on: str | list[str] | Column, how: str) -> DataFrame:
    """``df`` joined to ``keys``, which are broadcast if they have up to BROADCAST_ROWS ``rows``; else both are shuffled."""
    return df.join(F.broadcast(keys) if rows <= BROADCAST_ROWS else keys, on, how)


def bounded_batches(spark: SparkSession) -> None:
    """Let no Arrow batch for a worker exceed BATCH_BYTES, single rows aside, whatever its number of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Cut ``batch`` so that a slice holds few rows and, single rows aside, few bytes of text."""
    start, n = 0, batch.num_rows
    text = batch.column(column)
    sizes = pc.binary_length(text).to_pylist()
    while start < n:
        end, held = start, 0
        while end < n and end - start < SLICE_ROWS and (end == start or held + (sizes[end] or 0) <= SLICE_BYTES):
            held += sizes[end] or 0
            end += 1
        yield batch.slice(start, end - start)
        start = end


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | Iterable[dict]], schema: str, text_at: int = 1) -> DataFrame:
    """Apply ``fn`` to slices of ``df``; it returns the columns of the result by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    bounded_batches(df.sparkSession)
    spark_schema = _parse_datatype_string(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_at):
                out = fn(part)
                for columns in [out] if isinstance(out, dict) else out:
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, spark_schema)


def _stars(edges: DataFrame) -> bool:
    """Whether each u of ``edges(u, v)`` has one v only, and no v is a u: then each component is a star around its smallest id."""
    n, different = edges.agg(F.count("*"), F.count_distinct("u")).first()
    return n == different and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Smallest reachable id of every node in the undirected graph ``edges(a, b)``.

    Alternating large-star and small-star steps: each is a join and an aggregation whose
    output has one row for each edge, so no step gathers the edges of a node in one task.
    Returns (id, component_id) of the nodes in ``edges``; with ``nodes(id)``, of those too.
    The lineage is cut after each round in the shared checkpoint folder.
    """
    cur, rows = narrow(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(cur):
        # large star: every larger neighbour of u is tied to u's smallest neighbour (u included)
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large, _ = narrow(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u's smaller neighbours and u itself are tied to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur, rows = narrow(tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    found = cur.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    all_ids = found.unionByName(cur.select(F.col("v").alias("id")).distinct().withColumn("component_id", F.col("id")))
    if nodes is None:
        return all_ids
    return picked(nodes, all_ids, 2 * rows, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
