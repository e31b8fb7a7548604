"""Words of many texts at once, as 64-bit hashes made by whole-array steps.

A word is a run of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased.  Its hash is a
polynomial in an odd base over a random value for each byte, modulo 2**64, then mixed; a word's
share of the running sum over the whole buffer is divided by the power of the base where the word
begins, so that equal words have equal hashes wherever they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed in one go; a longer word is still hashed whole.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_P = np.uint64(_BASE)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = mix((_LOWER.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, as many as asked for at least."""
    if len(_powers[0]) < size:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(size, CHUNK + 1), base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers


def _hash(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data``, and where they begin; no word goes past one of ``edges`` (begins of texts)."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=total[1:])
    size = (end - begin).astype(np.uint64)
    return mix((total[end] - total[begin]) * inverse[begin] + size * _P), begin


def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, at): the word hashes of all texts, in order; those of text k are ``words[at[k]:at[k + 1]]``."""
    flat = pc.fill_null(texts, "").cast(pa.large_binary())
    if not len(flat):
        return np.empty(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    _, offsets, values = flat.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(values, dtype=np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.empty(0, dtype=np.uint8)
    edges = offsets - offsets[0]
    out, begins = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    for s, e in _chunks(data, edges):
        inner = edges[np.searchsorted(edges, s) : np.searchsorted(edges, e)]
        w, b = _hash(data[s:e], inner - s)
        out.append(w)
        begins.append(b + s)
    return np.concatenate(out), np.searchsorted(np.concatenate(begins), edges)


def _chunks(data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of ``data`` at ends of texts or at spaces, so that no word is cut."""
    s = 0
    while s < len(data):
        e = s + CHUNK
        if e >= len(data):
            yield s, len(data)
            return
        cut = int(edges[np.searchsorted(edges, e, side="right") - 1])
        if cut <= s:  # one text fills it: cut at a space
            spaces = np.flatnonzero(_SPACE[data[s + 1 : e]])
            if len(spaces):
                cut = s + 1 + int(spaces[-1])
            else:
                cut, k = len(data), e
                while k < len(data):
                    more = np.flatnonzero(_SPACE[data[k : k + CHUNK]])
                    if len(more):
                        cut = k + int(more[0])
                        break
                    k += CHUNK
                cut = min(cut, int(edges[np.searchsorted(edges, s, side="right")]) if np.searchsorted(edges, s, side="right") < len(edges) else cut)
        yield s, cut
        s = cut


def shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text; fewer words than ``n`` are one n-gram."""
    words, at = hashes(texts)
    whole = np.full(max(0, len(words) - n + 1), n, dtype=np.uint64)
    for k in range(n):
        whole = whole * _P + words[k : len(words) - n + 1 + k] if len(whole) else whole
    whole = mix(whole)
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s >= n:
            h = np.sort(whole[s : e - n + 1])
            out.append(h[np.append(True, h[1:] != h[:-1])])
        elif e > s:
            h = np.full(1, e - s, dtype=np.uint64)
            for k in range(s, e):
                h = h * _P + words[k]
            out.append(mix(h))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
