"""Reversible line dedup: sharded cuckoo filters over exact reference tables (operator 8).

A line's key is the line without white space at its ends, in lower case (A-Z); keys travel as
128-bit hashes.  ``postings`` are the distinct (key, document) pairs; ``references`` counts
the documents of each key and keeps the smallest.  Keys that are found in at least two
documents and have MIN_CHARS code points lose their lines in all documents but the smallest.

The keys with two or more documents are spread over shards, each with a cuckoo filter of at
most SHARD_KEYS keys.  A ``LineIndex`` holds postings, exact reference counts and filters; when
documents come or go, the counts take +1 and -1 merged by key, only keys that lose their smallest
document are looked up in the postings again, and only the shards of keys that begin or cease to
be shared are updated.  Deleting what was inserted gives the former state back.  A lookup asks the
filters first and then the exact table: filters of up to FILTER_BYTES in all (counted) are
broadcast, larger ones meet the postings shard by shard, each cut into chunks of CHUNK_ROWS.

Rows: a null or empty text is one empty line; lines of any length count whole; rows with a
null id neither hold nor lose lines; rows that repeat an id count as one document; an empty
table gives an empty table; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from . import common

MIN_CHARS = 10
#: Keys of one shard, roughly: as many shards are made as keep them below it on average.
SHARD_KEYS = 100_000
#: Filters are broadcast up to this size together.
FILTER_BYTES = 64 << 20
#: Postings that are looked up in one copy of a shard's filter, when filters aren't broadcast.
CHUNK_ROWS = 4_000_000
SLOTS = 4
MAX_KICKS = 500
#: Fixed value: white space that is stripped from a line's ends.
BLANKS = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes | None]:
    """The hash of each line's key; None where the key is too short to count."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):  # bytes.lower: A-Z alone
        key = line.strip(BLANKS)
        long = len(key) >= 4 * MIN_CHARS or len(key) >= MIN_CHARS and len(key.decode("utf-8", "surrogatepass")) >= MIN_CHARS
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key is its 128-bit hash as two integers."""

    def __init__(self, keys: int = 0, table: np.ndarray | None = None) -> None:
        need = max(2, int(keys / 0.85 / SLOTS) + 1)
        self.table = table if table is not None else np.zeros((1 << (need - 1).bit_length(), SLOTS), dtype=np.uint16)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(raw, dtype=np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        print_ = (h2.astype(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        print_[print_ == 0] = 1
        first = (h1.astype(np.uint64) >> np.uint64(16)) & mask
        return print_, first, first ^ self._other(print_)

    def _other(self, print_: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((print_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) & np.uint64(len(self.table) - 1)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        p, a, b = self.places(h1, h2)
        return ((self.table[a] == p[:, None]) | (self.table[b] == p[:, None])).any(axis=1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False if the keys don't fit; the filter is then to be built anew, larger."""
        p, a, b = self.places(h1, h2)
        table, other = self.table, self._other(np.arange(1 << 16, dtype=np.uint16)).tolist()
        for f, i, j in zip(p.tolist(), a.tolist(), b.tolist(), strict=True):
            for at in (i, j):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = f
                    break
            else:
                at = i
                for kick in range(MAX_KICKS):
                    slot = kick % SLOTS
                    f, table[at, slot] = int(table[at, slot]), f
                    at ^= other[f]
                    free = np.flatnonzero(table[at] == 0)
                    if len(free):
                        table[at, free[0]] = f
                        break
                else:
                    return False
        return True

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Takes out keys that were inserted."""
        for f, i, j in zip(*(x.tolist() for x in self.places(h1, h2)), strict=True):
            for at in (i, j):
                hit = np.flatnonzero(self.table[at] == f)
                if len(hit):
                    self.table[at, hit[0]] = 0
                    break


def built(h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
    size = max(64, len(h1))
    while not (f := CuckooFilter(size)).insert(h1, h2):
        size *= 2
    return f


def postings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct (h1, h2, doc_id) of the keys that count."""

    def fn(part: pa.RecordBatch) -> dict:
        ids, keys = [], []
        for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            found = {k for k in line_keys(t) if k is not None}
            keys += sorted(found)
            ids += [i] * len(found)
        h = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
        return {"h1": h[:, 0].copy(), "h2": h[:, 1].copy(), "doc_id": ids}

    narrow = df.where(df[id_col].isNotNull()).select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    return common.map_slices(narrow, fn, "h1 long, h2 long, doc_id long")


KEY = ["h1", "h2"]


def counted(posted: DataFrame) -> DataFrame:
    """The exact table of all keys of distinct postings: (h1, h2, refs, min_doc)."""
    return posted.groupBy(*KEY).agg(F.count("*").alias("refs"), F.min("doc_id").alias("min_doc"))


def references(posted: DataFrame) -> DataFrame:
    """The part of the exact table with at least two documents, of postings that may repeat."""
    return posted.groupBy(*KEY).agg(F.count("*").alias("refs"), F.min("doc_id").alias("min_doc"), F.max("doc_id").alias("max_doc")).where("min_doc < max_doc").drop("max_doc")


def change_postings(posted: DataFrame, inserted: DataFrame | None = None, deleted_ids: DataFrame | None = None) -> DataFrame:
    """Postings after documents have come (their postings, counted once however often they come) or gone (their ``doc_id``)."""
    if inserted is not None:
        posted = posted.unionByName(inserted.distinct().join(posted, [*KEY, "doc_id"], "left_anti"))
    return posted if deleted_ids is None else posted.join(deleted_ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*KEY, "doc_id")


def change_counts(counts: DataFrame, come: DataFrame, gone: DataFrame, after: DataFrame) -> DataFrame:
    """The exact table after the postings ``come`` were added and ``gone`` taken away, which leaves those of ``after``."""
    more = come.groupBy(*KEY).agg(F.count("*").alias("more"), F.min("doc_id").alias("new_min"))
    less = gone.groupBy(*KEY).agg(F.count("*").alias("less"), F.min("doc_id").alias("gone_min"))
    changed = more.join(less, KEY, "full").join(counts, KEY, "left")
    changed = changed.select(
        *KEY, (F.coalesce("refs", F.lit(0)) + F.coalesce("more", F.lit(0)) - F.coalesce("less", F.lit(0))).alias("refs"), F.least("min_doc", "new_min").alias("min_doc"),
        F.coalesce(F.col("gone_min") <= F.least("min_doc", "new_min"), F.lit(False)).alias("again"),
    ).where("refs > 0")
    changed = common.materialize(changed)
    again = after.join(changed.where("again").select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.min("doc_id").alias("left_min"))
    found = changed.join(again, KEY, "left").select(*KEY, "refs", F.when(F.col("again"), F.col("left_min")).otherwise(F.col("min_doc")).alias("min_doc"))
    touched = more.select(*KEY).unionByName(less.select(*KEY))
    return counts.join(touched, KEY, "left_anti").unionByName(found)


def build_shards(refs: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) over the keys of ``refs``."""

    def one(t: pa.Table) -> pa.Table:
        f = built(t.column("h1").to_numpy(), t.column("h2").to_numpy())
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int64()), "filter": pa.array([f.to_bytes()], pa.binary())})

    return refs.select(F.pmod("h1", F.lit(shards)).alias("shard"), "h1", "h2").groupBy("shard").applyInArrow(one, "shard long, filter binary")


def update_shards(filters: DataFrame, added: DataFrame, removed: DataFrame, shards: int) -> DataFrame:
    """The filters after keys have been added and removed; shards that neither concerns stay as they are."""

    def one(old: pa.Table, new: pa.Table) -> pa.Table:
        to = lambda op: new.filter(pc.equal(new.column("op"), op))
        ins, gone = to(1), to(-1)
        f = CuckooFilter.from_bytes(old.column("filter")[0].as_py()) if old.num_rows else CuckooFilter(max(64, ins.num_rows))
        f.delete(gone.column("h1").to_numpy(), gone.column("h2").to_numpy())
        if not f.insert(ins.column("h1").to_numpy(), ins.column("h2").to_numpy()):
            raise OverflowError("the shard is full; build the index anew")
        at = (old if old.num_rows else new).column("shard")[0].as_py()
        return pa.table({"shard": pa.array([at], pa.int64()), "filter": pa.array([f.to_bytes()], pa.binary())})

    changes = added.select("h1", "h2", F.lit(1).alias("op")).unionByName(removed.select("h1", "h2", F.lit(-1).alias("op")))
    changes = changes.withColumn("shard", F.pmod("h1", F.lit(shards)))
    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(one, "shard long, filter binary")


def shard_count(refs: DataFrame) -> int:
    return max(1, -(-refs.count() // SHARD_KEYS))


def _hits(f: CuckooFilter, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return f.contains(h1, h2) if len(h1) else np.zeros(0, dtype=bool)


def probe(posted: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Postings that can be of a key in ``filters`` (shard, filter)."""
    if shards * SHARD_KEYS * 4 > FILTER_BYTES:
        return probe_apart(posted, filters, shards)
    shared = posted.sparkSession.sparkContext.broadcast(dict(filters.select("shard", "filter").collect()))  # within FILTER_BYTES

    def run(batches):
        held = {s: CuckooFilter.from_bytes(bytes(x)) for s, x in shared.value.items()}
        for b in batches:
            h1, h2 = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            hit = np.zeros(len(h1), dtype=bool)
            shard = np.mod(h1, shards)
            for s, f in held.items():
                at = np.flatnonzero(shard == s)
                hit[at] = _hits(f, h1[at], h2[at])
            yield b.filter(pa.array(hit))

    return posted.mapInArrow(run, posted.schema)


def probe_apart(posted: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """``probe`` for filters of any size: each filter goes once to every chunk of its shard's postings, which stream past it."""
    placed = posted.withColumn("shard", F.pmod("h1", F.lit(shards)))
    chunks = placed.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("long").alias("chunks"))
    copies = filters.join(chunks, "shard").select("shard", "filter", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    left = copies.select("shard", "chunk", "filter", *[F.lit(None).cast("long").alias(c) for c in (*KEY, "doc_id")])
    right = placed.join(chunks, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), "chunks").alias("chunk"), F.lit(None).cast("binary").alias("filter"), *KEY, "doc_id")
    both = left.unionByName(right).repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", F.col("filter").isNull())

    def run(batches):
        held, of = None, None
        for b in batches:
            place = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            begin = [0, *(k for k in range(1, len(place)) if place[k] != place[k - 1])]
            for s, e in zip(begin, [*begin[1:], len(place)], strict=True):
                part = b.slice(s, e - s)
                if part.column(2)[0].is_valid:
                    held, of = CuckooFilter.from_bytes(part.column(2)[0].as_py()), place[s]
                    part = part.slice(1)
                if of == place[s] and part.num_rows:  # a shard without a filter has no shared key
                    h1, h2 = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))
                    yield part.select([3, 4, 5]).filter(pa.array(_hits(held, h1, h2)))

    return both.mapInArrow(run, "h1 long, h2 long, doc_id long")


@dataclass(frozen=True)
class LineIndex:
    """Which documents hold which lines, in a form that documents can be put into and taken out of."""

    posted: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def build(cls, posted: DataFrame) -> LineIndex:
        posted = common.materialize(posted.distinct())
        counts = common.materialize(counted(posted))
        shards = shard_count(counts.where("refs > 1"))
        return cls(posted, counts, common.materialize(build_shards(counts.where("refs > 1"), shards)), shards)

    def insert(self, posted: DataFrame) -> LineIndex:
        """With the postings of documents that come."""
        come = common.materialize(posted.distinct().join(self.posted, [*KEY, "doc_id"], "left_anti"))
        return self._changed(self.posted.unionByName(come), come, come.limit(0))

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents of ``ids(doc_id)``."""
        gone = common.materialize(self.posted.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select(*KEY, "doc_id"))
        return self._changed(change_postings(self.posted, deleted_ids=ids), gone.limit(0), gone)

    def _changed(self, after: DataFrame, come: DataFrame, gone: DataFrame) -> LineIndex:
        after = common.materialize(after)
        counts = common.materialize(change_counts(self.counts, come, gone, after))
        touched = come.unionByName(gone).select(*KEY).distinct()
        was, now = (c.where("refs > 1").join(touched, KEY, "left_semi").select(*KEY) for c in (self.counts, counts))
        shards = shard_count(counts.where("refs > 1"))
        if shards > 2 * self.shards:  # the shards have become too large
            return LineIndex(after, counts, common.materialize(build_shards(counts.where("refs > 1"), shards)), shards)
        return LineIndex(after, counts, common.materialize(update_shards(self.filters, now.exceptAll(was), was.exceptAll(now), self.shards)), self.shards)

    def drops(self) -> DataFrame:
        """(doc_id, gone): the keys whose lines each document loses."""
        return _drops(self.posted, self.counts.where("refs > 1"), self.filters, self.shards)


def _lost(posted: DataFrame, refs: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The postings (h1, h2, doc_id) of lines that go."""
    return probe(posted, filters, shards).join(refs.select(*KEY, "min_doc"), KEY).where("doc_id <> min_doc").select(*KEY, "doc_id")


def _gathered(lost: DataFrame) -> DataFrame:
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("gone"))


def _drops(posted: DataFrame, refs: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    return _gathered(_lost(posted, refs, filters, shards))


def drops(posted: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, gone): the hashes of the keys whose lines a document loses, sixteen bytes each."""
    shards = shard_count(refs)
    return _drops(posted, refs, build_shards(refs, shards), shards)


def _gone(keys: list | None) -> set[bytes]:
    return {int(k["h1"]).to_bytes(8, "little", signed=True) + int(k["h2"]).to_bytes(8, "little", signed=True) for k in keys or ()}


def cleaned(text: str | None, gone: set[bytes]) -> tuple[str, int, int]:
    """The text that stays, its number of lines before, and the number dropped."""
    lines = (text or "").split("\n")
    if not gone:
        return text or "", len(lines), 0
    stay = [line for line, k in zip(lines, line_keys(text), strict=True) if k is None or k not in gone]
    return "\n".join(stay), len(lines), len(lines) - len(stay)


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def lost_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``drops`` of ``df``.  Only the postings that go are written to the checkpoint folder, in few files; the rest stays with the executors meanwhile."""
    posted = postings(df, id_col, text_col).persist(StorageLevel.DISK_ONLY)
    refs = references(posted).persist(StorageLevel.DISK_ONLY)
    try:
        shards = shard_count(refs)
        lost, _ = common.narrow(_lost(posted, refs, build_shards(refs, shards), shards))
    finally:
        refs.unpersist()
        posted.unpersist()
    return _gathered(lost)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with its columns as they are, but for the lines that the text loses."""
    key, lost = _fresh(df, "doc"), _fresh(df, "lost")
    gone = lost_lines(df, id_col, text_col).select(F.col("doc_id").alias(key), F.col("gone").alias(lost))
    joined = df.join(gone, df[id_col] == gone[key], "left").drop(key)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, at):
                texts = [
                    t if not g else cleaned(t, _gone(g))[0]
                    for t, g in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True)
                ]
                columns = part.columns[:-1]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1])

    return joined.mapInArrow(run, df.schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those it loses, and a digest of what stays."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = lost_lines(docs).withColumnRenamed("doc_id", "key")
    joined = docs.join(gone, docs["doc_id"] == gone["key"], "left").drop("key")

    def fn(part: pa.RecordBatch) -> dict:
        rows = [cleaned(t, _gone(g)) for t, g in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
        return {
            "doc_id": part.column(0), "n_lines": [r[1] for r in rows], "n_dropped": [r[2] for r in rows],
            "kept_sha256": [hashlib.sha256(r[0].encode("utf-8", "surrogatepass")).hexdigest() for r in rows],
        }

    return common.map_slices(joined, fn, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as k from documents
), keyed as (
  select doc_id, line, k, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), dup as (
  select key, min(doc_id) as first_doc from keyed where length(key) >= 10 group by key having count(distinct doc_id) > 1
), judged as (
  select a.doc_id, a.line, a.k, (d.key is not null and d.first_doc <> a.doc_id) as gone from keyed a left join dup d on a.key = d.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by k) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""
