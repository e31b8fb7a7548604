"""Token counts by rank-synchronous merging of ragged arrays (operator 9).

New pre-tokens of a slice of documents are held in one flat array of symbols with the place
where each begins.  In every round each pre-token finds the lowest rank among its adjacent
pairs and merges all occurrences of that pair at once, left to right; pre-tokens without a
pair that merges leave the array.  The symbols that survive are counted.  Counts of
pre-tokens are remembered, up to a bound, for the slices that follow.

Rows: a null text counts as empty (0 bytes, 0 tokens); texts of any length are counted
whole; repeated rows each give a row; null ids are carried; an empty table gives an empty
table; columns other than the id and the text are not read.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import common
from .bpe import byte_alphabet

#: Documents with more tokens than this are marked.
LIMIT = 2048
#: Pre-tokens that one worker remembers before its memory of them is cleared.
CACHE_ENTRIES = 400_000
CACHE_CHARS = 48
#: Bytes of new pre-tokens merged in one call.
BATCH_BYTES = 4 << 20
NONE = np.int64(1 << 40)


class WordBpe:
    """A vocabulary of words in lower case whose last symbol carries an end mark."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        alphabet = byte_alphabet()
        self.inner = np.full(256, -1, dtype=np.int64)
        self.final = np.full(256, -1, dtype=np.int64)
        for c, b in alphabet.items():
            self.inner[b], self.final[b] = vocab.get(c, -1), vocab.get(c + suffix, -1)
        n = self.n = max(vocab.values()) + 1
        merged = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            merged.setdefault(vocab[a] * n + vocab[b], (rank, vocab[a + b]))
        keys = np.array(sorted(merged), dtype=np.int64)
        self.keys = np.append(keys, np.int64(1 << 60))
        self.rank = np.append(np.array([merged[k][0] for k in keys.tolist()], dtype=np.int64), NONE)
        self.made = np.append(np.array([merged[k][1] for k in keys.tolist()], dtype=np.int64), -1)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.splitter = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.known: dict[str, int] = {}
        self.lower = {}

    def merge_counts(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols of each piece after all merges; no piece is empty."""
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        last = np.cumsum(size) - 1
        sym = self.inner[flat]
        sym[last] = self.final[flat[last]]
        count = np.zeros(len(pieces), dtype=np.int64)
        owner = np.arange(len(pieces))
        bad = np.zeros(len(pieces), dtype=np.int64)
        if (sym < 0).any():  # symbols outside the vocabulary have no id and aren't counted
            np.add.at(bad, np.repeat(owner, size)[sym < 0], 1)
        while len(owner):
            seq = np.repeat(np.arange(len(owner)), size)
            pair = sym[:-1] * self.n + sym[1:]
            pair[(seq[:-1] != seq[1:]) | (sym[:-1] < 0) | (sym[1:] < 0)] = -1
            at = np.searchsorted(self.keys, pair)
            hit = self.keys[at] == pair
            rank = np.append(np.where(hit, self.rank[at], NONE), NONE)
            begin = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, begin)
            live = least < NONE
            count[owner[~live]] = size[~live]
            take = np.flatnonzero((rank == least[seq]) & (rank < NONE))
            if not len(take):
                break
            # where a pair overlaps itself, as in aaa, take every second place from the left
            touch = np.zeros(len(take), dtype=bool)
            touch[1:] = np.diff(take) == 1
            if touch.any():
                first = np.flatnonzero(~touch)
                run = np.repeat(first, np.diff(np.append(first, len(take))))
                take = take[(np.arange(len(take)) - run) % 2 == 0]
            sym[take] = self.made[at[take]]
            keep = live[seq]
            keep[take + 1] = False
            size = size - np.bincount(seq[take], minlength=len(size))
            sym, size, owner = sym[keep], size[live], owner[live]
        return count - bad

    def _prepare(self, text: str) -> str:
        """NFC, runs of white space as one space, lower case by character."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # str.lower looks at what stands around a capital sigma
                text = text.replace("Σ", "σ")
        return text.lower()

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings in the text."""
        if not text:
            return [], 0
        if self.splitter is None or not any(s in text for s in self.special):
            return self.pattern.findall(self._prepare(text)), 0
        parts = self.splitter.split(text)
        return [p for part in parts for p in self.pattern.findall(self._prepare(part))], len(parts) - 1

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        found = [self.pieces(t or "") for t in texts]
        known = self.known
        if len(known) >= CACHE_ENTRIES:
            known.clear()
        new = [p for p in dict.fromkeys(p for pieces, _ in found for p in pieces) if p not in known]
        here: dict[str, int] = {}
        at = 0
        while at < len(new):
            raw, held = [], 0
            while at + len(raw) < len(new) and (not raw or held < BATCH_BYTES):
                raw.append(new[at + len(raw)].encode("utf-8", "surrogatepass"))
                held += len(raw[-1])
            for p, n in zip(new[at:], self.merge_counts(raw).tolist(), strict=False):
                (known if len(p) <= CACHE_CHARS else here)[p] = n
            at += len(raw)
        if not here:
            return [sum(map(known.__getitem__, pieces)) + n for pieces, n in found]
        return [sum(known[p] if p in known else here[p] for p in pieces) + n for pieces, n in found]


@lru_cache(4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def count_tokens(df: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text."""

    def fn(part: pa.RecordBatch) -> dict:
        texts = part.column(1).to_pylist()
        n = load(path).counts(texts)
        sizes = pc.fill_null(pc.binary_length(part.column(1)), 0)
        return {"doc_id": part.column(0), "n_bytes": sizes.cast(pa.int64()), "n_tokens": n, "over_limit": [x > limit for x in n]}

    return common.map_slices(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")), fn, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document by the word vocabulary."""
    from .bpe import default_path

    return count_tokens(common.table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"))
