"""Exact n-gram Jaccard join and its components (operator 7).

A document is its set of hashed word n-grams.  Sets are put into bands by size; the universe
of hashes is cut into as many segments as a band's largest possible symmetric difference
needs.  Two similar sets differ in fewer tokens than there are segments, so they agree on a
segment, and the hash of a segment's subset of tokens is a signature they share.  Segments to
spare make up for the empty ones, which say nothing and are left out.  Small sets use fewer
segments and also index the subsets with one token left out (the one-deletion neighbourhood),
where that costs less; ``allocate`` weighs the two for each band.  A set has signatures for
its own band and, if it can be similar to larger sets there, for the next one, where it is a
visitor: two visitors needn't meet, they do so in their own band.

The sets that share a signature are a group, and follow the owner that comes first in a fixed
random order, their leader.  Two similar sets share a signature and so have a leader in common;
near copies share many signatures but few leaders, which is why all members of a leader go
through the checks together.  First their parity bitmaps (the bits in which two differ can't
outnumber the tokens in which the sets differ) leave out the members that can't be similar to
any other.  The texts of the rest follow, one for each leader that is left, and the sets themselves,
as 64-bit hashes of their n-grams, are compared for the pairs that bitmaps allow and no link has
connected yet, nearest first.  Leaders with many members are cut into chunks that each hold the
leader; what the chunks leave in several components is then compared across chunks: the members
outside the largest component with all others.

Signatures move as 30 bits within a bucket; a chance agreement costs a comparison and nothing
else.  Groups that are large within one batch of a worker send their first owner to the bucket
and the other members to any task, so that no task gathers the members of a frequent signature.

Rows: null texts and texts without a word have an empty set and link with nothing; fewer
words than n are one n-gram; texts of any length count whole; rows with a null id link with
nothing and keep a null component; rows that repeat an id are one document, with the links
of each; exact copies are one set and cost nothing further; ties of distance go by the order of
sizes and ids and change no result; an empty table gives an empty table; columns but the id and
the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import mix, shingles

N = 5
PERCENT = 80
#: Expected candidates that one chance agreement of nearly empty segments is taken to cost, in signatures.
CHANCE = 100.0
#: Members of a group in one batch beyond which they don't go to the bucket.
SMALL = 64
#: Documents, and signatures, that a worker sorts together.
FLUSH, FLUSH_SIGNATURES = 2048, 1 << 20
#: Documents to a bucket of signatures, roughly.
BUCKET_DOCS = 2000
#: Members, and bytes of text, that are compared at once.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Bytes of text, and members, to a call, roughly; many small groups go in one.
TASK_BYTES, TASK_MEMBERS = 2 << 20, 2048
#: Bits of a bitmap for a token, and the most bits of one.
FINE, MOST_BITS = 4, 1 << 16
_P = np.uint64(0x9E3779B97F4A7C15)
_VISITOR = np.uint64(1)


def most_apart(total, percent: int = PERCENT):
    """The largest symmetric difference of two similar sets with ``total`` tokens together."""
    return (100 - percent) * total // (100 + percent)


@lru_cache(8)
def upper(percent: int) -> list[int]:
    """Largest sizes of the bands: a similar set is in the same band or the next."""
    out = [1]
    while out[-1] < 1 << 31:
        out.append(max(out[-1] + 1, out[-1] * 100 // percent))
    return out


@lru_cache(None)
def allocate(band: int, percent: int = PERCENT) -> tuple[bool, int, int]:
    """(deletions, segments, spare) of a band: spare is how many empty segments a set may have."""
    u = upper(percent)[band]
    apart = most_apart(2 * u, percent)
    if apart == 0:
        return False, 0, 0
    size = u * (1 + percent / 100) / 2
    small = size * (1 + percent / 100) ** 2 / 4 if band else size  # between the band's smallest sets and its visitors
    spare = 0
    for _ in range(20):
        m = apart + 1 + spare
        blank = m * math.exp(-small / m)
        spare = math.ceil(blank + 2 * math.sqrt(blank))
    m = apart + 1 + spare
    half = -(-(apart + 1) // 2)
    plain_cost = m + CHANCE * m * math.exp(-size / m)
    deletion_cost = half + size + CHANCE * half * math.exp(-size / half)
    return (True, half, 0) if deletion_cost < plain_cost else (False, m, spare)


@lru_cache(None)
def segments(band: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """First hash of each segment, and a salt for each."""
    m = allocate(band, percent)[1]
    edges = np.array([(i << 64) // m for i in range(m)], dtype=np.uint64)
    return edges, mix(np.arange(m, dtype=np.uint64) * _P + np.uint64(band * 2654435761 + 1))


def signatures(h: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of a set; the lowest bit is set where the set is a visitor.

    Similar sets agree on more segments than ``spare``.  So if one has at most ``spare`` empty
    segments, they agree on one that isn't empty; else both have more, and agree on a filled one
    or on an empty one beyond the first ``spare`` segments, which such sets index too.
    """
    u = upper(percent)
    own = int(np.searchsorted(u, len(h)))
    bands = [own, own + 1] if 100 * len(h) >= percent * (u[own] + 1) else [own]
    token = mix(h + _P)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(token, dtype=np.uint64)])
    out = []
    for band in bands:
        deletions, m, spare = allocate(band, percent)
        if m == 0:
            continue
        edges, salt = segments(band, percent)
        at = np.append(np.searchsorted(h, edges), len(h))
        size = np.diff(at)
        s = total[at[1:]] - total[at[:-1]] + salt
        if deletions:
            got = np.concatenate([mix(s), mix(np.repeat(s, size) - token)])
        else:
            told = size > 0
            if m - np.count_nonzero(told) > spare:
                told[spare:] = True
            got = mix(s[told])
        out.append(got & ~_VISITOR if band == own else got | _VISITOR)
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def bitmap(h: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the number of tokens for each value of the lowest bits, of which there are ``bits`` values (a power of two, 64 or more)."""
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64)


def fine(h: np.ndarray) -> int:
    """Bits of the bitmap of a set by itself."""
    return min(MOST_BITS, max(64, 1 << int(FINE * len(h) - 1).bit_length()))


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap with fewer words."""
    return np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)


def close(size: np.ndarray, maps: list[bytes], percent: int = PERCENT) -> np.ndarray:
    """Which sets sizes and bitmaps allow to be similar to another one of them."""
    order = np.argsort(size, kind="stable")
    size, words = size[order], [np.frombuffer(maps[k], dtype="<u8") for k in order]
    width = np.array([len(w) for w in words])
    level = {}  # bitmaps of a width, of the sets that have it and those that have twice as much
    for w in np.unique(width).tolist():
        lo, hi = np.searchsorted(width, w), np.searchsorted(width, 2 * w, side="right")
        level[w] = int(lo), np.stack([folded(x, w) for x in words[lo:hi]])
    found = np.zeros(len(size), dtype=bool)
    least = np.searchsorted(size, -(-size * percent // 100))
    for x in range(1, len(size)):
        at = int(least[x])
        while at < x:
            w = int(width[at])
            end = min(x, int(np.searchsorted(width, w, side="right")))
            lo, m = level[w]
            own = m[x - lo] if width[x] <= 2 * w else folded(words[x], w)
            apart = np.bitwise_count(m[at - lo : end - lo] ^ own).sum(axis=1, dtype=np.int64)
            near = apart <= most_apart(size[at:end] + size[x], percent)
            found[at:end] |= near
            found[x] |= near.any()
            at = end
    out = np.empty(len(size), dtype=bool)
    out[order] = found
    return out


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact check of two sets."""
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = int(np.count_nonzero(x[at] == y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def connect(sets: list[np.ndarray], label: np.ndarray | None = None, side: np.ndarray | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect all similar sets: pairs of places, with no pair that other links connect already.

    ``label`` tells what is connected beforehand; with ``side``, only sets of different sides are compared.
    """
    size = np.array([len(h) for h in sets], dtype=np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    bits = fine(sets[order[-1]])
    maps = np.stack([bitmap(sets[k], bits) for k in order])
    group = np.arange(len(sets)) if label is None else np.unique(label, return_inverse=True)[1][order]
    side = None if side is None else side[order]
    least = np.searchsorted(size, -(-size * percent // 100))
    links = []
    for x in range(1, len(order)):
        lo = int(least[x])
        if lo >= x:
            continue
        apart = np.bitwise_count(maps[lo:x] ^ maps[x]).sum(axis=1, dtype=np.int64)
        near = (apart <= most_apart(size[lo:x] + size[x], percent)) & (group[lo:x] != group[x])
        if side is not None:
            near &= side[lo:x] != side[x]
        rest = np.flatnonzero(near)
        rest = rest[np.argsort(apart[rest], kind="stable")] + lo
        while len(rest):
            y, rest = rest[0], rest[1:]
            if similar(sets[order[y]], sets[order[x]], percent):
                links.append((int(order[y]), int(order[x])))
                group[group == group[y]] = group[x]
                rest = rest[group[rest] != group[x]]
    return links


def measure(docs: DataFrame, n: int) -> DataFrame:
    """(id, n, bytes, k1, k2): size of the set, bytes of text and a 128-bit key of the set, of every row."""

    def fn(part: pa.RecordBatch) -> dict:
        sets = shingles(part.column(1), n)
        keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h.tobytes()) for h in sets), dtype="<i8").reshape(-1, 2)
        return {"id": part.column(0), "n": [len(h) for h in sets], "bytes": pc.binary_length(part.column(1)), "k1": keys[:, 0].copy(), "k2": keys[:, 1].copy()}

    return common.map_slices(docs, fn, "id long, n long, bytes long, k1 long, k2 long")


_FOUND = pa.schema([("bucket", pa.int64()), ("leader", pa.int64()), ("id", pa.int64()), ("sig", pa.int64()), ("base", pa.int64()), ("sigs", pa.binary()), ("ids", pa.binary())])
_FOUND_SQL = "bucket long, leader long, id long, sig long, base long, sigs binary, ids binary"


def _rows(size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(size, f.type) for f in _FOUND], schema=_FOUND)


def _runs(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the runs of equal values in a sorted array."""
    begin = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.empty(0, dtype=np.int64)
    return begin, np.diff(np.append(begin, len(sig)))


def _rank(ids: np.ndarray) -> np.ndarray:
    """The fixed random order of ids; it tells any two apart."""
    return mix(ids.view(np.uint64) + _P)


def spread(docs: DataFrame, buckets_log2: int, n: int, percent: int) -> DataFrame:
    """Signatures by bucket: (base, sigs, ids), and of groups large in a batch one flagged entry there and members (sig, ids) in any bucket.

    An entry of ``sigs`` has 30 bits of the signature after those of the bucket, then one bit for
    a flagged entry and one for a visitor; ``ids`` has each entry's id less ``base``.
    """
    shift = np.uint64(64 - buckets_log2)

    def entries(sig: np.ndarray) -> np.ndarray:
        return ((sig << np.uint64(buckets_log2)) >> np.uint64(34) << np.uint64(2) | sig & _VISITOR).astype(np.uint32)

    def flush(ids: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sig = np.concatenate(sets)
        order = np.argsort(sig)
        sig, who = sig[order], np.repeat(np.array(ids, dtype=np.int64), [len(s) for s in sets])[order]
        entry = entries(sig)
        begin, size = _runs(sig >> _VISITOR)
        hot = size > SMALL
        if hot.any():
            keep = np.ones(len(sig), dtype=bool)
            tied, members, places = [], [], []
            for s, k in zip(begin[hot].tolist(), size[hot].tolist(), strict=True):
                owners = int((sig[s : s + k] & _VISITOR == 0).sum())
                first = s + int(np.argmin(_rank(who[s : s + (owners or k)])))
                keep[s : s + k] = False
                keep[first] = True
                entry[first] |= 2
                tied.append(_group(int(sig[s] >> shift), int(entry[first])))
                members.append(who[s : s + k].astype("<i8").tobytes())
                places.append(int(_rank(who[first : first + 1])[0] >> shift))
            yield _rows(len(tied), bucket=places, sig=tied, ids=members)
            sig, who, entry = sig[keep], who[keep], entry[keep]
        bucket = (sig >> shift).astype(np.int64)
        begin, size = _runs(bucket)
        base = int(who.min())
        far = (who - base).astype(np.uint64)
        far = far.astype("<u4") if far.max() < 1 << 32 else far.astype("<u8")
        parts = list(zip(begin.tolist(), (begin + size).tolist(), strict=True))
        yield _rows(len(parts), bucket=bucket[begin], base=np.full(len(parts), base), sigs=[entry[s:e].tobytes() for s, e in parts], ids=[far[s:e].tobytes() for s, e in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sets: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for part in common.slices(batch, 1):
                for i, h in zip(part.column(0).to_pylist(), shingles(part.column(1), n), strict=True):
                    s = signatures(h, percent) if len(h) else h
                    if len(s):
                        ids.append(i)
                        sets.append(s)
                        held += len(s)
                    if len(ids) >= FLUSH or held >= FLUSH_SIGNATURES:
                        yield from flush(ids, sets)
                        ids, sets, held = [], [], 0
        if ids:
            yield from flush(ids, sets)

    return docs.mapInArrow(run, _FOUND_SQL)


def _group(bucket: int, entry: int) -> int:
    """A number for a group, from its bucket and an entry."""
    return int(mix(np.array([bucket * 0x9E3779B97F4A7C15 + (entry >> 2) & (1 << 64) - 1], dtype=np.uint64)).view(np.int64)[0])


def _gather(t: pa.Table) -> pa.Table:
    """Of one bucket: (leader, id) of the groups, (sig, leader) of those with flagged entries, and the members (sig, ids) as they came."""
    tied = t.filter(pc.is_valid(t.column("sig")))
    out = [tied.combine_chunks().to_batches()[0]] if tied.num_rows else []
    raw = t.filter(pc.is_null(t.column("sig")))
    if raw.num_rows:
        entry, ids = [], []
        for base, a, b in zip(raw.column("base").to_pylist(), raw.column("sigs").to_pylist(), raw.column("ids").to_pylist(), strict=True):
            entry.append(np.frombuffer(a, dtype="<u4"))
            ids.append(np.frombuffer(b, dtype="<u4" if len(a) == len(b) else "<u8").astype(np.int64) + base)
        entry, ids = np.concatenate(entry), np.concatenate(ids)
        order = np.argsort(entry >> 2, kind="stable")
        entry, ids = entry[order], ids[order]
        begin, size = _runs(entry >> 2)
        flagged = np.maximum.reduceat(entry & 2, begin) > 0
        owned = np.minimum.reduceat(entry & 1, begin) == 0
        pick = owned & ((size > 1) | flagged)  # without an owner there is nothing to find here
        inside = np.repeat(pick, size)
        entry, ids, size, flagged = entry[inside], ids[inside], size[pick], flagged[pick]
        if len(ids):
            begin = np.cumsum(size) - size
            rank = np.where(entry & 1 > 0, np.uint64(0xFFFFFFFFFFFFFFFF), _rank(ids))
            least = np.minimum.reduceat(rank, begin)
            first = np.flatnonzero(rank == np.repeat(least, size))
            first = first[np.searchsorted(first, begin)]
            x, y = _distinct_pairs(np.repeat(ids[first], size), ids)
            out.append(_rows(len(x), leader=x, id=y))
            at = first[flagged]
            if len(at):
                bucket = int(raw.column("bucket")[0].as_py())
                out.append(_rows(len(at), sig=[_group(bucket, int(e)) for e in entry[at]], leader=ids[at]))
    return pa.Table.from_batches(out, schema=_FOUND)


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    key = np.unique(at[: len(a)].astype(np.int64) << 32 | at[len(a) :])
    return ids[key >> 32], ids[key & 0xFFFFFFFF]


def _listed(found: DataFrame) -> DataFrame:
    """(leader, id) of rows (leader, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leader, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = np.frombuffer(ids, dtype="<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), leader)), pa.array(m)], names=["leader", "id"])

    return found.mapInArrow(run, "leader long, id long")


def followers(docs: DataFrame, rows: int, n: int, percent: int) -> tuple[DataFrame, int]:
    """(leader, id), distinct, and how many: members of the groups by signature, and each leader as a member of its own."""
    buckets_log2 = max(8, min(33, (rows // BUCKET_DOCS).bit_length()))
    found = common.materialize(spread(docs, buckets_log2, n, percent).groupBy("bucket").applyInArrow(_gather, _FOUND_SQL).select("leader", "id", "sig", "ids"))
    pairs = found.where("id is not null").select("leader", "id")
    led, few = common.narrow(found.where("sig is not null and leader is not null").select("sig", "leader"))
    if few:
        pairs = pairs.unionByName(_listed(common.picked(found.where("ids is not null").select("sig", "ids"), led, few, "sig", "inner").select("leader", "ids")))
    pairs = pairs.where("leader <> id")
    return common.narrow(pairs.unionByName(pairs.select("leader", F.col("leader").alias("id"))).distinct())


def likely(docs: DataFrame, near: DataFrame, rows: int, n: int, percent: int) -> tuple[DataFrame, int]:
    """``near``, and how many, without the members that sizes and bitmaps keep from any link; of leaders with over BLOCK members, all."""
    large, many = common.narrow(near.groupBy("leader").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK).select("leader"))
    small, rest = near, None
    if many:
        small, rest = (common.picked(near, large, many, "leader", how) for how in ("left_anti", "left_semi"))

    def maps(part: pa.RecordBatch) -> dict:
        sets = shingles(part.column(1), n)
        return {"id": part.column(0), "n": [len(h) for h in sets], "map": [bitmap(h, fine(h)).tobytes() if len(h) else bytes(8) for h in sets]}

    def one(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        leader, size, ids = (t.column(c).to_numpy() for c in ("leader", "n", "id"))
        order = np.argsort(leader, kind="stable")
        keep = np.zeros(len(leader), dtype=bool)
        for s, k in zip(*(x.tolist() for x in _runs(leader[order])), strict=True):
            at = order[s : s + k]
            keep[at] = close(size[at], t.column("map").take(pa.array(at)).to_pylist(), percent)
        return pa.table({"leader": leader[keep], "id": ids[keep]})

    known = common.map_slices(common.picked(docs, small.select("id").distinct(), rows, "id", "left_semi"), maps, "id long, n long, map binary")
    tasks = max(64, rows // TASK_MEMBERS)
    placed = small.join(known, "id").withColumn("task", F.pmod(F.xxhash64("leader"), F.lit(tasks)))
    left = placed.select("task", "leader", "id", "n", "map").groupBy("task").applyInArrow(one, "leader long, id long").distinct()
    return common.narrow(left if rest is None else left.unionByName(rest))


def _compared(rows: DataFrame, tasks: int, n: int, percent: int) -> DataFrame:
    """Links (a, b) of ``rows`` (place, id, text, label, side), each place for itself; a null label is its own, null sides are different."""

    def one(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        place = t.column("place").to_numpy()
        order = np.argsort(place, kind="stable")
        begin, size = _runs(place[order])
        a, b = [], []
        for s, k in zip(begin.tolist(), size.tolist(), strict=True):
            if k < 2:
                continue
            part = t.take(pa.array(order[s : s + k]))
            ids, text = part.column("id").to_numpy(), part.column("text").combine_chunks()
            sets = [h for lo in range(0, k, common.SLICE_ROWS) for h in shingles(text.slice(lo, common.SLICE_ROWS), n)]
            label = side = None
            if part.column("label").null_count == 0:
                label, side = part.column("label").to_numpy(), part.column("side").to_numpy()
                side = None if side.min() == side.max() else side
            for x, y in connect(sets, label, side, percent):
                a.append(ids[x])
                b.append(ids[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = rows.withColumn("task", F.pmod(F.xxhash64("place"), F.lit(tasks)))
    return rows.select("task", "place", "id", "text", "label", "side").groupBy("task").applyInArrow(one, "a long, b long")


def links(docs: DataFrame, sets: DataFrame, near: DataFrame, rows: int, n: int, percent: int) -> DataFrame:
    """Links (a, b) that connect the similar sets among the members of each leader."""
    if not rows:
        return near.select(F.col("leader").alias("a"), F.col("id").alias("b"))
    sizes = sets.groupBy("id").agg(F.max("bytes").alias("bytes"))
    members = near.join(sizes, "id").groupBy("leader").agg(F.count("*").alias("k"), F.sum("bytes").alias("bytes"))
    members = members.withColumn("chunks", F.ceil(F.greatest(F.col("k") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("long"))
    members, leaders = common.narrow(members)
    volume, most = members.agg(F.sum("bytes"), F.max("chunks")).first()
    texts = common.picked(docs, near.select("id").distinct(), rows, "id", "left_semi")
    tasks = max(64, volume // TASK_BYTES)
    none = [F.lit(None).cast("long").alias(c) for c in ("label", "side")]
    if most == 1:
        return common.narrow(_compared(near.join(texts, "id").select(F.col("leader").alias("place"), "id", "text", *none), tasks, n, percent))[0]
    texts = common.materialize(texts)
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks"))
    placed = common.picked(near, members.select("leader", "chunks"), leaders, "leader", "inner").select("leader", "id", "chunks", F.when(F.col("leader") == F.col("id"), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(chunk)).alias("chunk"))
    placed = placed.select("leader", "id", F.explode("chunk").alias("chunk")).select(F.xxhash64("leader", "chunk").alias("place"), "id").join(texts, "id")
    first, _ = common.narrow(_compared(placed.select("place", "id", "text", *none), tasks, n, percent))
    # what is left in several components, across the chunks of a leader
    label = common.connected_components(first.distinct(), near.select("id").distinct()).withColumnRenamed("component_id", "label")
    each, _ = common.narrow(near.join(members.where("chunks > 1").select("leader", "chunks"), "leader").join(label, "id"))
    parts = each.groupBy("leader", "chunks", "label").agg(F.count("*").alias("k"))
    torn = parts.groupBy("leader", "chunks").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("all"), (F.sum("k") - F.max("k")).alias("others")).where("others > 0")
    torn, _ = common.narrow(torn.withColumn("cells", F.ceil(F.col("others") * F.col("chunks") / F.col("all")).cast("long")))
    copies = torn.agg(F.sum(F.col("all") * F.col("cells") + F.col("others") * F.col("chunks"))).first()[0]
    if not copies:
        return first
    each = each.join(torn.select("leader", "main", "cells"), "leader").withColumn("other", F.col("label") != F.col("main"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("other"), F.col("cells")).otherwise(F.col("chunks")))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    place = lambda kind, i, j, side: F.struct(F.xxhash64("leader", F.lit(kind), i, j).alias("place"), side.cast("long").alias("side"))
    among = F.transform(upto("cells"), lambda k: place("others", F.least(own, k), F.greatest(own, k), own))
    to_main = F.transform(upto("chunks"), lambda k: place("main", own, k, F.lit(-1)))
    mains = F.transform(upto("cells"), lambda k: place("main", k, own, F.lit(0)))
    placed = each.select("id", "label", F.inline(F.when(F.col("other"), F.concat(among, to_main)).otherwise(mains))).join(texts, "id")
    return first.unionByName(common.narrow(_compared(placed, max(64, int(copies) // BLOCK), n, percent))[0])


def components(df: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    docs = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    sets = common.materialize(measure(docs, n))
    known = docs.where("id is not null")
    filled = sets.where("n > 0 and id is not null")
    classes, many = common.narrow(filled.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("k")).where("k > 1").select("k1", "k2", "rep"))
    owned = common.picked(filled.select("id", "k1", "k2"), classes, many, ["k1", "k2"], "left").select("id", F.coalesce("rep", "id").alias("rep")).distinct()
    copies, _ = common.narrow(owned.where("id <> rep"))
    # of ids with a copy elsewhere, those without a set of their own as well
    gone, few = common.narrow(copies.select("id").distinct().join(owned.where("id = rep").select("id"), "id", "left_anti"))
    near, rows = followers(common.picked(known, gone, few, "id", "left_anti"), max(1, sets.count()), n, percent)
    near, rows = likely(known, near, rows, n, percent)
    found = links(known, filled, near, rows, n, percent).unionByName(copies.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    return common.connected_components(found, sets.select("id", F.col("n").alias("n_shingles"))).select("id", "n_shingles", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df``, columns as they are, with one document of each component: the one with the smallest id."""
    found = components(df, id_col=id_col, text_col=text_col)
    gone, few = common.narrow(found.where("id <> component_id").select(F.col("id").alias("__gone")).distinct())
    return common.picked(df, gone, few, df[id_col] == gone["__gone"], "left_anti")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under word 5-gram Jaccard similarity of 0.8 or more."""
    found = components(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
