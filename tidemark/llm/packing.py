"""Harmonic packing of documents into sequences of at most ``capacity`` tokens (operator 4).

Documents that fit into a sequence go whole, by harmonic classes: class k holds the lengths
over capacity / (k + 1) and up to capacity / k, and its bins take exactly k of them.  What a
bin has left is filled from one document more, which is cut there; longer documents, which have
to be cut anyway, serve for that, and what they don't fill makes full sequences.  If bins wait
for want of those, the documents of some are cut to fill the others.  Each worker fills its own
bins from its own rows, without a shuffle.  At its end a worker lays what its open bins hold
end to end and cuts that at the capacity and then at powers of two, so that the last sequences
need no padding either.  Documents of equal length go to a bin in the order of the rows.

A sequence id is the number of the partition times 2^40 plus a count, so the same split of
the input gives the same ids when a lost task runs again.

Rows: a null text counts as empty and gives one piece, the closing id alone; null ids are
carried; repeated rows are packed each; a document of any length is packed whole; an empty
table gives an empty table; columns other than the id and the text are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

CAPACITY = 1024
#: Tokens of documents that are being cut which a worker keeps to fill bins, and full bins that wait for them.
RESERVE, WAITING = 16 * 1024, 256
#: What is too long between white space for an encoder whose work grows with the square of it.
LONG_RUN = re.compile(r"\S{4000}")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tokens:
    """Ids of texts by tiktoken's encoder over the vocabulary and merges of a tokenizers file."""

    def __init__(self, path: str) -> None:
        import tiktoken

        from .bpe import PRETOKEN, byte_alphabet

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        ranks = {bytes([b]): b for b in range(256)}
        ids = {}
        vocab = spec["model"]["vocab"]
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            ranks.setdefault(bytes(alphabet[c] for c in a + b), len(ranks))
        for s, i in vocab.items():
            ids[ranks[bytes(alphabet[c] for c in s)]] = i
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = set(special)
        plain = tiktoken.Encoding("ranks", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={s: len(ranks) + i for i, s in enumerate(special)})
        for s, i in special.items():
            ids[plain._special_tokens[s]] = i
        if missing := [r for r in range(len(ranks) + len(special)) if r not in ids]:
            raise ValueError(f"the vocabulary lacks {len(missing)} merged tokens")
        self.ids = np.array([ids[r] for r in range(len(ranks) + len(special))], dtype="<u4")
        self.plain, self.path = plain, path

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if LONG_RUN.search(text):  # its merges take the square of a run's length; the other encoder takes its length
            from .bpe import load as linear

            return linear(self.path).encode(text)
        return self.ids[self.plain.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())].tobytes()


@lru_cache(4)
def load(path: str) -> Tokens:
    return Tokens(path)


def harmonic(length: int, capacity: int = CAPACITY) -> int:
    """The class of a length: how many documents of it a bin takes."""
    return capacity // length


class Worker:
    """Bins of one worker; a piece is (doc_id, start, its ids, tokens of the document)."""

    def __init__(self, partition: int, capacity: int = CAPACITY) -> None:
        self.capacity, self.next_id = capacity, partition << 40
        self.open: dict[int, list[tuple]] = {}  # the bin of each class that has less than its number of documents
        self.waiting: deque[tuple[list[tuple], int]] = deque()  # bins with theirs, and the tokens that they have left
        self.cut: deque[tuple] = deque()  # documents that fill them
        self.spare = 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, offset
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        """Rows of the bins that the document fills."""
        piece = doc_id, 0, memoryview(ids), len(ids) // 4  # cutting it copies nothing
        if len(ids) // 4 > self.capacity:
            yield from self._offer(piece)
        else:
            yield from self._place(piece)
        while self.spare > RESERVE:
            doc_id, start, ids, total = piece = self.cut.popleft()
            self.spare -= min(len(ids) // 4, self.capacity)
            if len(ids) // 4 > self.capacity:
                yield from self._close([(doc_id, start, ids[: 4 * self.capacity], total)])
                self.cut.appendleft((doc_id, start + self.capacity, ids[4 * self.capacity :], total))
            else:
                yield from self._place(piece)
        while len(self.waiting) > WAITING:
            yield from self._dissolve()

    def _place(self, piece: tuple) -> Iterator[tuple]:
        """Put a piece of at most the capacity into the bin of its class."""
        k = harmonic(len(piece[2]) // 4, self.capacity)
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            del self.open[k]
            self.waiting.append((held, self.capacity - sum(len(p[2]) // 4 for p in held)))
            yield from self._fill()

    def _offer(self, piece: tuple) -> Iterator[tuple]:
        self.cut.append(piece)
        self.spare += len(piece[2]) // 4
        yield from self._fill()

    def _fill(self) -> Iterator[tuple]:
        """Fill waiting bins from the documents that are being cut, both in the order of their coming."""
        while self.waiting and (self.cut or not self.waiting[0][1]):
            held, room = self.waiting.popleft()
            if room:
                doc_id, start, ids, total = self.cut.popleft()
                n = min(room, len(ids) // 4)
                held.append((doc_id, start, ids[: 4 * n], total))
                room -= n
                self.spare -= n
                if 4 * n < len(ids):
                    self.cut.appendleft((doc_id, start + n, ids[4 * n :], total))
            if room:
                self.waiting.appendleft((held, room))
            else:
                yield from self._close(held)

    def _dissolve(self) -> Iterator[tuple]:
        """Cut the documents of the waiting bin that came last to fill the others."""
        for piece in self.waiting.pop()[0]:
            yield from self._offer(piece)

    def finish(self) -> Iterator[tuple]:
        """Rows of what bins still hold, laid end to end."""
        while len(self.waiting) > 1:
            yield from self._dissolve()
        rest = [*self.cut, *(p for held, _ in self.waiting for p in held), *(p for k in sorted(self.open) for p in self.open[k])]
        left = sum(len(p[2]) // 4 for p in rest)
        rest.reverse()
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            held = []
            while room:
                doc_id, start, ids, total = rest.pop()
                n = len(ids) // 4
                if n > room:
                    rest.append((doc_id, start + room, ids[4 * room :], total))
                    ids, n = ids[: 4 * room], room
                held.append((doc_id, start, ids, total))
                room -= n
            yield from self._close(held)


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row for each piece of each document, with its sequence and the place in it."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity has to be a power of two")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyspark import TaskContext

        tokens = load(path)
        closing = end_id.to_bytes(4, "little")
        context = TaskContext.get()
        worker = Worker(context.partitionId() if context else 0, capacity)
        for batch in batches:
            for part in common.slices(batch, 1):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    yield from worker.add(doc_id, tokens.encode(text or "") + closing)
        yield from worker.finish()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows(batches):
            held.append(row)
            if len(held) >= 20_000:
                yield made(held)
                held = []
        if held:
            yield made(held)

    def made(held: list[tuple]) -> pa.RecordBatch:
        names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*held, strict=True)], names=names)

    return df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Packs the whole of ``documents``."""
    from .bpe import default_path

    return pack_documents(common.table(spark, sf_dir, "documents"), default_path())
