"""Vectorised splitting and hashing of words, straight on Arrow's UTF-8 buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
ODD = 0x9E3779B97F4A7C15
SLICE_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiply-xorshift hash, on an array."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def byte_codes(lower: bool = True) -> np.ndarray:
    """A 64-bit code for each byte; A-Z share those of a-z if lower."""
    b = np.arange(256, dtype=np.uint64)
    if lower:
        b[65:91] += U(32)
    return mix(b * U(ODD) + U(1))


def alnum_bytes() -> np.ndarray:
    """True for the bytes of words: digits, letters and every byte of a multi-byte character."""
    m = np.zeros(256, bool)
    m[0x30:0x3A] = m[0x41:0x5B] = m[0x61:0x7B] = m[0x80:] = True
    return m


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return (data[off[0] : off[-1]], off - off[0]) if len(col) else (data[:0], np.zeros(1, np.int64))


def slices(off: np.ndarray, limit: int = SLICE_BYTES, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes each, and at most so many rows; a longer row makes a range alone, and is never cut."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        b = min(b, n, a + (rows or n))
        yield a, b
        a = b


class WordHasher:
    """Finds the words of many texts at once and hashes each: a polynomial of byte codes modulo 2^64, from prefix sums."""

    def __init__(self, lower: bool = True) -> None:
        self.codes, self.member = byte_codes(lower), alnum_bytes()
        self.pow = self.inv = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.pow) < n:
            n = max(n, SLICE_BYTES + 1)
            one = np.ones(1, np.uint64)
            with np.errstate(over="ignore"):
                self.pow = np.concatenate([one, np.cumprod(np.full(n - 1, ODD, np.uint64))])
                self.inv = np.concatenate([one, np.cumprod(np.full(n - 1, pow(ODD, -1, 1 << 64), np.uint64))])

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts whose bytes lie end to end: each word's first byte, its end, its hash, and the index of each text's first word (and the end)."""
        n = len(data)
        inside = self.member[data]
        starts_here = inside.copy()
        starts_here[1:] &= ~inside[:-1]
        first = off[:-1][off[:-1] < n]
        starts_here[first] = inside[first]
        starts = np.flatnonzero(starts_here)
        ends_here = inside.copy()
        ends_here[:-1] &= ~inside[1:] | starts_here[1:]
        ends = np.flatnonzero(ends_here) + 1
        self._grow(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.codes[data] * self.pow[:n], out=sums[1:])
            h = mix((sums[ends] - sums[starts]) * self.inv[starts] + (ends - starts).astype(np.uint64))
        return starts, ends, h, np.searchsorted(starts, off)


def word_slices(hasher: WordHasher, data: np.ndarray, off: np.ndarray, overlap: int, limit: int | None = None) -> Iterator[tuple]:
    """Texts whose bytes lie end to end, hashed at most limit bytes at a time: (a, b, base, last, own bytes, *what the hasher gives).

    Rows a to b come whole, with base 0. A longer row comes alone, in pieces that end between words and share overlap words, so
    any overlap + 1 words in a row lie together in one piece; base counts the words before the piece, and last marks its last.
    """
    limit = limit or SLICE_BYTES
    for a, b in slices(off, limit):
        start, end = int(off[a]), int(off[b])
        if end - start <= limit:
            own = data[start:end]
            yield a, b, 0, True, own, *hasher(own, off[a : b + 1] - start)
            continue
        base, room = 0, limit
        while True:
            stop = min(start + room, end)
            while stop < end and hasher.member[data[stop - 1]]:  # to the end of the word
                gap = np.flatnonzero(~hasher.member[data[stop : min(stop + limit, end)]])
                stop = stop + int(gap[0]) if len(gap) else min(stop + limit, end)
                if len(gap):
                    break
            own = data[start:stop]
            starts, ends, h, first = hasher(own, np.array([0, len(own)]))
            last = stop == end
            yield a, b, base, last, own, starts, ends, h, first
            if last:
                break
            n = len(starts)
            if n > overlap:
                base, room = base + n - overlap, limit
                start += int(starts[n - overlap]) if overlap else len(own)
            elif n:
                start, room = start + int(starts[0]), 2 * (stop - start - int(starts[0]))
            else:
                start = stop


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k neighbouring words (of any text; the caller drops runs across texts)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * U(0xD6E8FEB86659FD93) + h[j : j + n]
        return mix(out)
