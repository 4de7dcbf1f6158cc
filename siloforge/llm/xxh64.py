"""XXH64 of many byte strings at once, in numpy: the strings lie in one buffer."""

from __future__ import annotations

import numpy as np
import xxhash

#: Fixed values of the algorithm.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
LONG = 512


def turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def rounded(v: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return turned(v + lane * P2, 31) * P1


def hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """The hash of data[s:e] for each start and end."""
    buffer = data + bytes(8)
    at8 = np.ndarray(len(data) + 1, "<u8", buffer, strides=(1,))  # eight bytes from any byte on
    pos, size, s = starts.astype(np.int64), (ends - starts).astype(np.int64), np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(pos), s + P5)
        big = np.flatnonzero((size >= 32) & (size <= LONG))
        if len(big):
            p, stripes = pos[big], size[big] // 32
            v = [np.full(len(big), x) for x in (s + P1 + P2, s + P2, s, s - P1)]
            for i in range(int(stripes.max())):
                on = np.flatnonzero(stripes > i)
                for j in range(4):
                    v[j][on] = rounded(v[j][on], at8[p[on] + 32 * i + 8 * j])
            own = turned(v[0], 1) + turned(v[1], 7) + turned(v[2], 12) + turned(v[3], 18)
            for x in v:
                own = (own ^ rounded(np.zeros_like(x), x)) * P1 + P4
            h[big] = own
            pos[big] += 32 * stripes
        h += size.astype(np.uint64)
        left = size % 32
        for i in range(3):
            on = np.flatnonzero(left >= 8 * (i + 1))
            h[on] = turned(h[on] ^ rounded(np.zeros(len(on), np.uint64), at8[pos[on] + 8 * i]), 27) * P1 + P4
        pos += left & 24
        on = np.flatnonzero(left & 4)
        h[on] = turned(h[on] ^ ((at8[pos[on]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        pos += left & 4
        for i in range(3):
            on = np.flatnonzero((left & 3) > i)
            h[on] = turned(h[on] ^ ((at8[pos[on] + i] & np.uint64(0xFF)) * P5), 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], seed)
    return h
