"""Hashes of all words of many texts in a few numpy passes over their bytes.

A word's hash is a polynomial in its bytes modulo 2^64, taken as a difference of
prefix sums, then mixed; words beyond `LONG` bytes, where such polynomials can be made
to collide, are hashed with BLAKE2. 64 bits keep chance collisions below one in a
million even for texts of ten million words.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import blake2b

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
LONG = 256
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    size = 1
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * np.uint64(pow(base, size, 1 << 64))
        size += more
    return out


_pow = [_powers(1 << 16, BASE), _powers(1 << 16, pow(BASE, -1, 1 << 64))]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ h >> np.uint64(30)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end) of raw."""
    n = len(raw)
    if len(_pow[0]) < n + 1:
        _pow[0], _pow[1] = _powers(n + 1, BASE), _powers(n + 1, pow(BASE, -1, 1 << 64))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _pow[0][:n], out=total[1:])
    out = mix((total[ends] - total[starts]) * _pow[1][starts])
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = int.from_bytes(blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with A-Z in lower case: the bytes of all, each word's start, end and
    hash, and the number of words of each text. A word is a run of bytes that are
    not ASCII white space."""
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    raw = _LOWER[np.frombuffer(b"\n".join(parts), np.uint8)]
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    text_ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, text_ends))))
    return raw, starts, ends, span_hashes(raw, starts, ends), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles of `size` words, sorted, and their numbers. Fewer
    words than that form one shingle; no words form none."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    at = np.arange(len(hashes)) - first[owner]
    whole = counts >= size
    start = np.flatnonzero(at + size <= counts[owner])
    h = np.zeros(len(start), np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(BASE) + hashes[start + k] + np.uint64(k + 1))
    own = owner[start]
    short = np.flatnonzero(~whole & (counts > 0))
    extra = []
    for d in short.tolist():
        x = np.uint64(counts[d])
        with np.errstate(over="ignore"):
            for w in hashes[first[d] : first[d] + counts[d]]:
                x = mix(np.array([x * np.uint64(BASE) + w]))[0]
        extra.append(x)
    if len(short):
        own = np.concatenate((own, short))
        h = np.concatenate((h, np.array(extra, np.uint64)))
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[keep], np.bincount(own[keep], minlength=len(counts))
