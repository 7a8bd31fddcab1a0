"""Vectorised word and hash work on Arrow string columns, for the operators written in numpy.

Nothing here loops over words in Python: bytes are classified by table, words are hashed from
prefix sums of a polynomial modulo 2**64, and groups are reduced over sorted runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer text is handled alone, in pieces of about as many.
CHUNK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of letter runs: white space and every ASCII byte that is no letter or digit.
NO_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seed(i: int) -> np.uint64:
    return np.uint64(mix(np.array([(i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)], dtype=np.uint64))[0])


BYTE_NUMBERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@cache
def _tile(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (BASE, BASE_INVERSE):
        a = np.full(n, b, dtype=np.uint64)
        a[0] = 1
        out.append(np.cumprod(a, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; tables for one chunk are kept, longer ones are not."""
    up, down = _tile(CHUNK_BYTES + 2) if n <= CHUNK_BYTES + 2 else _tile.__wrapped__(n)
    return up[:n], down[:n]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) for runs of rows of about `size` bytes; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """The words of some texts: where they start and end, whose they are, and their hashes."""

    def __init__(self, data: np.ndarray, off: np.ndarray, sep: np.ndarray, lower: bool):
        self.n, self.off = len(off) - 1, off
        self.data = data = LOWER[data] if lower else data
        inside = ~sep[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = off[:-1][off[:-1] < off[1:]]
        first[edges] = inside[edges]
        self.start = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[off[1:][off[:-1] < off[1:]] - 1] = inside[off[1:][off[:-1] < off[1:]] - 1]
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(off, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=self.n) if len(self.doc) else np.zeros(self.n, np.int64)
        self.sums: np.ndarray | None = None

    def second_hashes(self) -> np.ndarray:
        """Another 64-bit hash of each word, over other numbers for the bytes: words that agree in `hashes` need not agree here."""
        up, down = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(BYTE_NUMBERS[self.data] * up[:-1], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])

    def hashes(self, end: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes (up to `end`, if given)."""
        up, down = powers(len(self.data) + 1)
        if self.sums is None:
            self.sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])
        return mix((self.sums[self.end if end is None else end] - self.sums[self.start]) * down[self.start])


def long_text(data: np.ndarray, sep: np.ndarray, lower: bool, overlap: int = 0) -> Iterator[tuple[int, Words]]:
    """(first byte, words) of pieces of one text of about CHUNK_BYTES, cut at separators.

    Each piece but the first begins with the last `overlap` words of the one before it, so every
    run of overlap + 1 words lies in exactly one piece. A piece grows until it has more words.
    """
    at, step = 0, CHUNK_BYTES
    while True:
        end = min(len(data), at + step)
        if end < len(data):
            cuts = np.flatnonzero(sep[data[at:end]])
            end = at + int(cuts[-1]) + 1 if len(cuts) else at
        w = Words(data[at:end], np.array([0, end - at]), sep, lower)
        if end < len(data) and len(w.start) <= overlap:
            step *= 2
            continue
        yield at, w
        if end == len(data):
            return
        at, step = at + int(w.start[len(w.start) - overlap]) if overlap else end, CHUNK_BYTES


def group_starts(ids: np.ndarray) -> np.ndarray:
    """Where each run of equal ids begins."""
    return np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)


WEIGHT = [seed(1000 + i) | np.uint64(1) for i in range(8)]


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets of texts with A-Z lower-cased; one long text is worked through in pieces."""
    if len(off) > 2 or len(data) <= CHUNK_BYTES:
        return shingle_sets(Words(data, off, SPACE, lower=True), k)
    found, held = [], 0
    for at, w in long_text(data, SPACE, True, k - 1):
        if at and len(w.start) < k:
            continue  # nothing but the words of the piece before
        found.append(shingle_sets(w, k)[1])
        held += len(found[-1])
        if held > 4 * CHUNK_BYTES and len(found) > 1:
            found = [np.unique(np.concatenate(found))]
            held = 0
    s = np.unique(np.concatenate(found))
    return np.zeros(len(s), np.int64), s


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of the distinct k-word shingles, sorted; fewer than k words make one shingle."""
    h = w.hashes()
    doc = w.doc
    parts_d, parts_s = [], []
    if len(h) >= k:
        at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
        s = np.zeros(len(at), np.uint64)
        for i in range(k):
            s += h[at + i] * WEIGHT[i]
        parts_d.append(doc[at])
        parts_s.append(mix(s))
    short = (w.count > 0) & (w.count < k)
    if short.any():
        begin = np.r_[0, np.cumsum(w.count)[:-1]]
        d = np.flatnonzero(short)
        s = w.count[d].astype(np.uint64) * seed(999)
        for i in range(k - 1):
            has = w.count[d] > i
            s[has] += h[begin[d[has]] + i] * WEIGHT[i]
        parts_d.append(d)
        parts_s.append(mix(s))
    if not parts_d:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    d, s = np.concatenate(parts_d), np.concatenate(parts_s)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (s[1:] != s[:-1])] if len(d) else np.zeros(0, bool)
    return d[new], s[new]
