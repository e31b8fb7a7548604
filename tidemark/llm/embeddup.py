"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables (operator 10).

Exact copies are merged first.  A rotation that balances binary codes is learned from a
bounded sample (SAMPLE_ROWS) of the distinct vectors; as many rotations are learned as the
code needs bits.  The code is cut into chunks, a table for each; two vectors are candidates
if some chunk differs in at most ``radius`` bits: each vector is in each table once and
looks up all values within the radius.  Chunks widen with the logarithm of the number of
vectors, so the expected bucket doesn't grow, and the number of tables is chosen so that a
pair at the threshold is missed with a probability of at most MISS (bits taken as independent,
each differing with probability angle / pi).  Codes are taken after the mean is subtracted, which
widens the angle of a pair, so the angle is that of the centred vectors, on average over the
sample; a length that would need more than MAX_TABLES for that isn't centred, but projected on
random directions.  A pair is taken in the first table that finds
it; pairs whose whole codes are too far apart go; the rest is reranked by the cosine of the
original vectors in double precision.  Components are found over the links.

The most frequent lengths of vectors have learned rotations (MAX_LENGTHS); vectors of any other
length are projected on random directions seeded by the length, which each worker makes for itself.

Vectors in the same bucket follow the one of theirs that comes first in a fixed random order, and
those within half the threshold's angle of the vector they follow are a ball: all of them link
with each other, so their links are counted by the ball's size and never made.  Other links are
made, since they are counted; of two vectors that differ in a chunk, only the one with a 0 in the
lowest differing bit looks the other up.  Hot buckets are split by the skew join.

Rows: null vectors, vectors with a null or non-finite component, zero vectors and rows with a
null id link with nothing (a null id has a null component and is kept); vectors of different
lengths never link; rows that repeat an id and a vector each give a row, and count once; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.95
SAMPLE_ROWS = 20_000
ROTATION_STEPS = 40
MISS = 0.02
#: Tables beyond which the vectors of a length aren't centred.
MAX_TABLES = 64
#: Vector lengths, the most frequent first, that have rotations of their own; the others have seeded projections.
MAX_LENGTHS = 64


def chunk_hit(p: float, width: int, radius: int) -> float:
    return sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(radius + 1))


def rate(threshold: float, r2: np.ndarray) -> np.ndarray:
    """Chance that a bit differs between vectors at the threshold whose centred lengths, squared, are ``r2``."""
    return np.arccos(np.clip(1 - (1 - threshold) / np.maximum(r2, 1e-12), -1, 1)) / math.pi


def tables_for(p: np.ndarray, width: int, radius: int) -> int | None:
    """Tables with which pairs whose bits differ with the chances ``p`` are missed by MISS on average; None: over MAX_TABLES."""
    miss = 1 - chunk_hit(p, width, radius)
    return next((k for k in range(2, MAX_TABLES + 1) if np.mean(miss**k) <= MISS), None)


def plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int, int]:
    """(chunk width, radius, tables) for n vectors that aren't centred."""
    p = math.acos(threshold) / math.pi
    width = min(30, max(10, math.ceil(math.log2(max(2, n)))))
    radius = 1 if width <= 18 else 2
    tables = math.ceil(math.log(MISS) / math.log(1 - chunk_hit(p, width, radius)))
    return width, radius, max(2, tables)


def rotation(x: np.ndarray, bits: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions, turned so that signs lose least."""
    mean = x.mean(0)
    centred = x - mean
    _, _, axes = np.linalg.svd(np.cov(centred.T) if len(x) > 1 else np.eye(x.shape[1]))
    axes = axes[:bits].T
    v = centred @ axes
    turn, _ = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))
    for _ in range(ROTATION_STEPS):
        b = np.where(v @ turn >= 0, 1.0, -1.0)
        s, _, t = np.linalg.svd(b.T @ v)
        turn = t.T @ s.T
    return mean, axes @ turn


def fit(x: np.ndarray, bits: int, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rotations that together give ``bits`` bits, from rows of unit length."""
    rng = np.random.default_rng(seed)
    out, left = [], bits
    while left > 0:
        take = min(left, x.shape[1])
        mean, proj = rotation(x, x.shape[1], rng)
        out.append((mean, proj[:, :take]))
        left -= take
    return out


@lru_cache(8)
def seeded(d: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Random directions for vectors of length ``d``, the same in every worker."""
    return [(np.zeros(d), np.random.default_rng(d).normal(size=(d, bits)))]


def chunks(x: np.ndarray, model: list, width: int, tables: int) -> np.ndarray:
    """Codes of rows of unit length: one integer for each table."""
    bits = np.concatenate([(x - mean) @ proj >= 0 for mean, proj in model], axis=1)
    weight = (1 << np.arange(width)).astype(np.int64)
    return np.stack([bits[:, t * width : (t + 1) * width] @ weight for t in range(tables)], axis=1)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, d)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, h1, h2) of the vectors that can link, in double precision."""
    v = F.col("vec")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(df[id_col].cast("long").alias("id"), df[vec_col].cast("array<double>").alias("vec")).where("id is not null and vec is not null").where(fine)
    return rows.select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))


def cosine_at_least(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose vectors' cosine is at least ``least``, in double precision."""
    left = reps.select(F.col("id").alias("a"), F.col("vec").alias("va"))
    right = reps.select(F.col("id").alias("b"), F.col("vec").alias("vb"))

    def rerank(batches):
        for batch in batches:
            va, vb = batch.column(2), batch.column(3)
            size, other = (np.array(pc.list_value_length(v).to_pylist(), dtype=np.int64) for v in (va, vb))
            hit = np.zeros(len(size), dtype=bool)
            for d in np.unique(size).tolist():
                at = np.flatnonzero((size == d) & (other == d))
                if len(at):
                    x, y = matrix(va.take(pa.array(at)), d), matrix(vb.take(pa.array(at)), d)
                    hit[at] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))) >= least
            yield batch.select([0, 1]).filter(pa.array(hit))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(rerank, "a long, b long")


def balls(codes: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(id, ball): vectors that all lie within half the threshold's angle of the vector ``ball``, which is one of them."""
    keyed = codes.select("id", F.posexplode("code").alias("t", "c"), "d").select("id", F.xxhash64("t", "c", "d").alias("key"))
    rank = lambda c: F.struct(F.xxhash64(F.lit(3), c).alias("r"), F.col(c).alias("v"))
    lead = codes.select("id", F.col("id").alias("lead"))
    for _ in range(2):  # the first of its buckets, then the first that those in its buckets follow
        first = keyed.join(lead, "id").groupBy("key").agg(F.min(rank("lead")).alias("first"), F.count("*").alias("k")).where("k > 1")
        lead = common.materialize(keyed.join(first, "key").groupBy("id").agg(F.min("first")["v"].alias("lead")))
    half = math.sqrt((1 + threshold) / 2) + 1e-9  # beyond rounding
    near = cosine_at_least(lead.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")), reps, half)
    near = common.materialize(near.select(F.col("b").alias("id"), F.col("a").alias("ball")))
    # a vector that others follow is of their ball, and of no other
    leads = near.select("ball").distinct()
    members = near.join(leads.select(F.col("ball").alias("id")), "id", "left_anti")
    return common.materialize(members.unionByName(leads.select(F.col("ball").alias("id"), "ball")))


def candidate_links(reps: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(a, b): distinct vectors whose cosine is at least the threshold, as the tables find them, but for those of one ball; (id, ball)."""
    spark = reps.sparkSession
    width, radius, tables = plan(n, threshold)
    lengths = [r[0] for r in reps.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(MAX_LENGTHS).collect()]
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    drawn = reps.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("vec")
    samples = {}
    for d in lengths:
        x = drawn.where(F.size("vec") == d).toArrow().column("vec").combine_chunks()  # about SAMPLE_ROWS at most
        if not len(x):
            continue
        x = unit(matrix(x, d))
        needed = tables_for(rate(threshold, ((x - x.mean(0)) ** 2).sum(1)), width, radius)
        if needed is not None:
            samples[d], tables = x, max(tables, needed)
    bits = width * tables
    models = {d: fit(x, bits) for d, x in samples.items()}
    shared = spark.sparkContext.broadcast(models)

    def encode(batches):
        for batch in batches:
            ids, vecs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            size = np.array(pc.list_value_length(vecs).to_pylist(), dtype=np.int64)
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                model = shared.value.get(d) or seeded(d, bits)
                x = unit(matrix(vecs.take(pa.array(at)), d))
                code = chunks(x, model, width, tables)
                p = rate(threshold, ((x - model[0][0]) ** 2).sum(1))
                far = np.ceil(bits * p + 5 * np.sqrt(bits * p * (1 - p))).astype(np.int64)  # five deviations over what a pair at the threshold has
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([d] * len(at), pa.int32()), pa.array(list(code), pa.list_(pa.int64())), pa.array(far)], names=["id", "d", "code", "far"])

    common.bounded_batches(spark)
    codes = common.materialize(reps.select("id", "vec").mapInArrow(encode, "id long, d int, code array<long>, far long"))
    ball = balls(codes, reps, threshold)
    codes = codes.join(ball, "id", "left")
    masks = [sum(1 << i for i in c) for k in range(radius + 1) for c in _choices(width, k)]
    key = lambda c: F.shiftleft(F.col("t").cast("long"), 56).bitwiseOR(F.shiftleft(F.col("d").cast("long"), 32)).bitwiseOR(c)
    each = lambda side: codes.select(F.col("id").alias(side), "d", *[F.col(c).alias(f"{c}_{side}") for c in ("code", "far", "ball")], F.posexplode("code").alias("t", "c"))
    index = each("b").select(key(F.col("c")).alias("key"), "b", "code_b", "far_b", "ball_b")
    mask = F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")
    asked = each("a").select("a", "code_a", "far_a", "ball_a", "t", "d", "c", mask).where(F.col("c").bitwiseAND(F.col("mask").bitwiseAND(-F.col("mask"))) == 0).select("a", "code_a", "far_a", "ball_a", "t", "mask", key(F.col("c").bitwiseXOR(F.col("mask"))).alias("key"))
    near = lambda k: F.bit_count(F.col("code_a")[k].bitwiseXOR(F.col("code_b")[k]))
    far = F.greatest("far_a", "far_b")  # the shorter of two centred vectors bounds the angle between them
    first = F.lit(True)
    for k in range(tables - 1):
        first = first & ((F.col("t") <= k) | (near(k) > radius))
    pairs = asked.join(index, "key").where("(mask > 0 or a < b) and not coalesce(ball_a = ball_b, false)").where(sum((near(k) for k in range(1, tables)), near(0)) <= far).where(first)
    return cosine_at_least(pairs.select("a", "b"), reps, threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ball


def _choices(n: int, k: int):
    from itertools import combinations

    return combinations(range(n), k)


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    good = common.materialize(usable(df, id_col, vec_col))
    classes = good.select("id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = common.materialize(classes)
    reps = common.materialize(good.select("id", "vec", "h1", "h2").join(classes.select("h1", "h2", F.col("rep").alias("id")), ["h1", "h2", "id"]).dropDuplicates(["id", "h1", "h2"]).select("id", "vec"))
    n = reps.count()
    sizes = classes.groupBy("rep").agg(F.sum("n").alias("n"))  # the same id with several vectors is one node
    if n > 1:
        links, ball = candidate_links(reps, n, threshold)
        links, _ = common.narrow(links.distinct())
    else:
        links, ball = (df.sparkSession.createDataFrame([], f"{a} long, {b} long") for a, b in (("a", "b"), ("id", "ball")))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes.select(F.col("rep").alias("b"), "n"), "b").select(F.col("a").alias("rep"), "n")
    held = ball.join(sizes.select(F.col("rep").alias("id"), "n"), "id")
    within = held.join(held.groupBy("ball").agg(F.sum("n").alias("all")), "ball").select(F.col("id").alias("rep"), (F.col("all") - F.col("n")).alias("n"))
    others = others.unionByName(within).groupBy("rep").agg(F.sum("n").alias("others"))
    found = common.connected_components(links.unionByName(ball.select(F.col("ball").alias("a"), F.col("id").alias("b")))).withColumnsRenamed({"id": "rep"})
    node = (
        classes.join(others, "rep", "left").join(found, "rep", "left")
        .select("h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[vec_col].cast("array<double>").alias("vec"))
    linked = good.select(F.col("id").alias("vec_id"), "h1", "h2").join(node, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    v = F.col("vec")
    fine = F.coalesce(
        F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
