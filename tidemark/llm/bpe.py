"""Byte-level BPE: backtracking encoder and offset-table decoder (operator 3).

Encoding is exact: for each pre-token an Aho-Corasick automaton gives the longest
vocabulary entry at every position; a candidate is accepted only if the pair it forms with
the token before it is one that merging by rank could leave side by side, else the next
shorter prefix is tried, and failing those the last token is taken back.  Work is linear in
the pre-token.  Decoding gathers bytes by an offset table with numpy.

Rows: a null text counts as empty (no ids, empty decoded text); a text of any length is
encoded whole; repeated rows and repeated ids each give their own row; an empty table gives
an empty table; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: Fixed value: the pre-tokenisation pattern that goes with the public byte-level vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens, and stretches between spaces, that one worker remembers before it clears its memory of them.
CACHE_ENTRIES = 300_000
#: Pairs whose compatibility one worker remembers.
JOIN_ENTRIES = 400_000
#: Longer stretches than this are not remembered.
CACHE_CHARS = 48


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stays, the rest moves above 255."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Joins(dict):
    """The pair-compatibility table, filled as pairs are met: whether a token may stand before another."""

    def __init__(self, rule) -> None:
        self.rule = rule

    def __missing__(self, key: int) -> bool:
        if len(self) >= JOIN_ENTRIES:
            self.clear()
        self[key] = got = self.rule(key >> 17, key & 0x1FFFF)
        return got


class BlankEdge(Exception):
    """A chunk is empty or begins or ends with white space."""


class Pieces(dict):
    """Ids of pre-tokens; a bounded memory."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        bpe = self.bpe
        got = bpe.ids[bpe.encode_piece(piece.encode("utf-8", "surrogatepass"))].tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = got
        return got


class Chunks(dict):
    """Ids of what stands after a space and up to the next one; a bounded memory."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe = bpe

    def first(self, chunk: str) -> bytes:
        if chunk[:1].isspace() or chunk[-1:].isspace() or not chunk:
            raise BlankEdge
        return b"".join(map(self.bpe.pieces.__getitem__, self.bpe.pattern.findall(chunk)))

    def __missing__(self, chunk: str) -> bytes:
        if chunk[:1].isspace() or chunk[-1:].isspace() or not chunk:
            raise BlankEdge
        if chunk.isalpha():  # letters alone make one pre-token with the space
            got = self.bpe.pieces[" " + chunk]
        elif chunk[:-1].isalpha() and chunk[-1] in ".,":
            got = self.bpe.pieces[" " + chunk[:-1]] + self.bpe.pieces[chunk[-1]]
        else:
            got = b"".join(map(self.bpe.pieces.__getitem__, self.bpe.pattern.findall(" " + chunk)))
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = got
        return got


class Bpe:
    """Tables of one vocabulary.  Internally tokens are numbered by rank: bytes first, then merges."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = {to_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = [bytes([b]) for b in range(256)]
        number = {s: i for i, s in enumerate(names)}
        left, right = list(range(256)), list(range(256))
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            x, y = to_bytes(a), to_bytes(b)
            pair = (number[x], number[y])
            if x + y in number:  # a second way to an entry: it merges, but only the first way splits it
                self.pairs.setdefault(pair, number[x + y])
                continue
            number[x + y] = self.pairs[pair] = len(names)
            names.append(x + y)
            left.append(pair[0])
            right.append(pair[1])
        self.left, self.right, self.names = left, right, names
        self.ids = np.array([vocab[s] for s in names], dtype="<u4")
        # text as Latin-1: one character for each byte
        self.automaton = ahocorasick.Automaton()
        for s, i in number.items():
            self.automaton.add_word(s.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(names)
        for i, s in enumerate(names):
            for n in range(len(s) - 1, 0, -1):
                if (k := number.get(s[:n])) is not None:
                    self.shorter[i] = k
                    break
        self.length = [len(s) for s in names]
        self.joins = Joins(self._joins)
        self.whole = bytearray(len(names))
        for i in range(len(names)):  # halves come before the token that they make
            self.whole[i] = self._whole(i)
        self.pattern = regex.compile(PRETOKEN)
        self.splitter = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces, self.chunks = Pieces(self), Chunks(self)
        by_id = {vocab[s]: s for s in names} | {i: s.encode() for s, i in self.special.items()}
        size = max(by_id) + 1
        parts = [by_id.get(i, b"") for i in range(size)]
        self.blob = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def _joins(self, a: int, b: int) -> bool:
        """Whether merging by rank can leave a and b side by side.

        Undo merges, the later one first, along the touching edges.  If at some point the two
        pieces at the border have a merge that comes before the ones undone so far, merging
        would have joined them there.
        """
        bound = 1 << 60
        left, right, pairs = self.left, self.right, self.pairs
        while True:
            if (m := pairs.get((a, b))) is not None and m < bound:
                return False
            if a > b:
                if a < 256:
                    return True
                bound, a = a, right[a]
            else:
                if b < 256:
                    if a < 256:
                        return True
                    bound, a = a, right[a]
                else:
                    bound, b = b + 1, left[b]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ranks of the tokens of one pre-token."""
        text = piece.decode("latin-1")
        matches, joins, whole = self.automaton.iter_long, self.joins, self.whole
        # the longest matches one after another are right unless a pair of them doesn't hold
        out = [token for _, token in matches(text)]
        last = -1
        for at, token in enumerate(out):
            if not whole[token] or last >= 0 and not joins[last << 17 | token]:
                break
            last = token
        else:
            return out
        del out[at:]
        length, shorter, n = self.length, self.shorter, len(piece)
        closed = set()  # positions shown to lead nowhere
        at = sum(length[t] for t in out)
        token = next(matches(text, at))[1]
        while True:
            while token >= 0:
                if whole[token] and (end := at + length[token]) not in closed and (not out or joins[out[-1] << 17 | token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                at = end
                token = next(matches(text, at))[1]
            else:
                closed.add(at)
                if not out:
                    raise ValueError("no exact encoding; the vocabulary lacks single bytes")
                last = out.pop()
                at -= length[last]
                token = shorter[last]

    def _whole(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token: its halves stand together until their merge."""
        if token < 256:
            return True
        a, b = self.left[token], self.right[token]
        if not (self.whole[a] and self.whole[b]):
            return False
        x, y, bound = a, b, token
        while True:
            m = self.pairs.get((x, y))
            if m is not None and m < bound:
                return False
            if x > y and x >= 256:
                bound, x = min(bound, x), self.right[x]
            elif y >= 256:
                bound, y = min(bound, y + 1), self.left[y]
            elif x >= 256:
                bound, x = min(bound, x), self.right[x]
            else:
                return True

    def _ordinary(self, text: str) -> bytes:
        """A space between two characters that aren't white space begins a pre-token, so what
        stands between such spaces is encoded by itself and remembered as a whole."""
        first, *rest = text.split(" ")
        try:
            return self.chunks.first(first) + b"".join(map(self.chunks.__getitem__, rest))
        except BlankEdge:  # runs of white space: a pre-token may reach over the cut
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special strings inside the text give their ids."""
        if not text:
            return b""
        if self.splitter is None or not any(s in text for s in self.special):
            return self._ordinary(text)
        out, at = [], 0
        for m in self.splitter.finditer(text):
            out += [self._ordinary(text[at : m.start()]), self.special[m.group()].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._ordinary(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids, gathered by the offset table; invalid UTF-8 becomes U+FFFD."""
        x = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        if not len(x):
            return b""
        begin, size = self.offsets[x], self.offsets[x + 1] - self.offsets[x]
        ends = np.cumsum(size)
        at = np.repeat(begin - (ends - size), size) + np.arange(ends[-1])
        raw = self.blob[at].tobytes()
        try:
            raw.decode("utf-8")
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode("utf-8")


@lru_cache(4)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every text."""

    def fn(part: pa.RecordBatch) -> dict:
        bpe = load(path)
        ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
        return {
            "id": part.column(0),
            "ids": [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids],
            "decoded": [bpe.decode(x).decode("utf-8") for x in ids],
        }

    return common.map_slices(df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text")), fn, "id long, ids array<int>, decoded string")


def digest_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Round trip of every text, reduced to digests where the ids are made."""

    def fn(part: pa.RecordBatch) -> dict:
        bpe = load(path)
        ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
        return {
            "doc_id": part.column(0),
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
        }

    return common.map_slices(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")), fn, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Exact byte-level BPE of every document and its decoding, as digests."""
    return digest_documents(common.table(spark, sf_dir, "documents"), default_path())
